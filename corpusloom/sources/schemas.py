"""Declared schemas of the inputs."""

USERS = "id string, full_name string, first_name string, last_name string, email string, created_at string, updated_at string"
ARTICLES = "id string, link string, platform string, author_id string, author_full_name string, content map<string,string>, created_at string, updated_at string"
REPOSITORIES = "id string, name string, link string, platform string, author_id string, author_full_name string, content map<string,string>, created_at string, updated_at string"
RAW_REPOSITORY = "repository_url string, owner string, name string, extracted_at string, files map<string,struct<content:string,size:bigint,language:string>>"
RAW_ARTICLE = "url string, link string, platform string, extracted_at string, title string, content string, content_length bigint, extraction_method string"
CHUNKS = "text string, chunk_id string, document_id string, document_type string, chunk_index int, metadata map<string,string>, embedding array<float>"
PAIRS = "instruction string, output string"
TRIPLES = "instruction string, generated_answer string, extracted_answer string"
CACHE = "cache_key string, url string, content_type string, cached_at timestamp, bytes bigint"
TRAINING_ARTICLES = "id string, content string, platform string, author_id string, author_full_name string, link string"
