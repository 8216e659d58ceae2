"""URL and path rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def netloc(url: Column) -> Column:
    """Host with port and user, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    """A percent-decoded query parameter; null if absent."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.try_url_decode(F.nullif(raw, F.lit("")))


#: Platform by part of the host, in order.
PLATFORMS = {"medium.com": "medium", "linkedin.com": "linkedin", "substack.com": "substack", "github.com": "github"}


def platform(url: Column, platforms: dict[str, str] | None = None, default: str = "unknown") -> Column:
    host, out = netloc(url), None
    for part, name in (platforms or PLATFORMS).items():
        out = (F.when if out is None else out.when)(F.contains(host, F.lit(part)), name)
    return out.otherwise(default)


def link_group(url: Column) -> Column:
    """Which crawl a link belongs to, by part of the link; blog if none."""
    out = None
    for part, name in (("medium", "medium"), ("github", "github"), ("linkedin", "linkedin"), ("substack", "substack")):
        out = (F.when if out is None else out.when)(F.contains(url, F.lit(part)), name)
    return out.otherwise("personal_blogs")


def dispatch(url: Column, domains: dict[str, str], default: str = "custom") -> Column:
    """The first handler whose domain the link starts with, https and an optional www. before it."""
    out = None
    for domain, handler in domains.items():
        out = (F.when if out is None else out.when)(url.rlike("^https://(www\\.)?" + domain.replace(".", "\\.")), handler)
    return F.lit(default) if out is None else out.otherwise(default)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def code_host_kind(url: Column, host: str = "github.com") -> Column:
    """profile (one path part), repository (two or more) or null."""
    n = F.size(path_parts(url))
    return F.when(netloc(url) != host, None).when(n == 1, "profile").when(n >= 2, "repository")


def professional_link_kind(url: Column) -> Column:
    """profile, post or article by path."""
    return F.when(F.contains(url, F.lit("/in/")), "profile").when(F.contains(url, F.lit("/posts/")) | F.contains(url, F.lit("/feed/update/")), "post").when(F.contains(url, F.lit("/pulse/")), "article").otherwise("other")


def redirect_target(url: Column, part: str = "medium.com/m/signin") -> Column:
    """Where a sign-in link leads; other links are themselves."""
    return F.when(F.contains(url, F.lit(part)), F.coalesce(query_value(url, "redirect"), url)).otherwise(url)


def is_article_of(href: Column, profile: Column, site: str = "medium.com") -> Column:
    """Whether a link is an article of a profile, through a sign-in redirect or directly."""
    user = F.regexp_replace(F.element_at(F.split(profile, "/"), -1), "^@+", "")
    signin = F.contains(href, F.lit(f"{site}/m/signin")) & F.contains(href, F.lit("redirect="))
    target = query_value(href, "redirect")
    through = F.coalesce(F.contains(target, F.concat(F.lit("@"), user)) & (F.char_length(target) > F.char_length(profile)), F.lit(False))
    direct = F.contains(href, F.lit(site)) & F.contains(href, user) & (href != profile) & ~F.endswith(href, F.concat(F.lit("/"), user))
    return F.when(signin, through).otherwise(direct)


#: Language by file suffix.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "cpp": "cpp", "c": "c", "cs": "csharp", "go": "go", "rs": "rust", "php": "php",
    "rb": "ruby", "swift": "swift", "kt": "kotlin", "scala": "scala", "r": "r", "sql": "sql", "sh": "bash", "html": "html", "css": "css", "scss": "scss",
    "sass": "sass", "less": "less", "xml": "xml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "txt": "text", "dockerfile": "dockerfile",
}


def file_language(file: Column) -> Column:
    """By the last suffix of the file name; a leading dot makes no suffix."""
    suffix = F.regexp_extract(F.lower(file), r"[^/]\.([^./]+)$", 1)
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, suffix), F.lit("unknown"))


#: Suffixes that are not text.
BINARY = "png jpg jpeg gif bmp ico svg pdf doc docx xls xlsx ppt pptx zip tar gz rar 7z exe dll so dylib mp3 mp4 avi mov wav ttf otf woff woff2".split()


def skip_file(file: Column, size: Column, most: int = 1024 * 1024) -> Column:
    return (size > most) | F.lower(file).rlike(r"\.(" + "|".join(BINARY) + ")$")


def safe_name(url: Column, at: Column, most: int = 50) -> Column:
    """The last path part with other characters than letters, digits, - and _ replaced, and a time."""
    last = F.element_at(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"), -1)
    return F.concat(F.substring(F.regexp_replace(last, r"[^\p{L}\p{N}\-_]", "_"), 1, most), F.lit("_"), at.cast("long").cast("string"))


def cache_key(kind: Column, url: Column) -> Column:
    return F.md5(F.concat_ws(":", kind, url))
