"""The ten operators against brute force on a small table with every awkward case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, components, decontaminate, exact_dedup, langid, license_scan, packing, quality, secrets_scan, simhash, simple8b, substring_dedup, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, unit int, h string, __n int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def cases():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["Été", "straße", "日本", "ÀÉ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = text(60), text(9000)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a b c d"), (6, text(13)), (7, long), (8, long + " tail"), (9, passage), (10, text(20) + " " + passage + "\n" + text(30)),
        (11, passage.replace(" ", "\n", 5)), (12, passage.upper()), (13, "x y " * 400), (14, "x y " * 200 + "z"), (15, text(5) + " " + passage[: len(passage) // 2]), (16, "nbsp\xa0here   wide \x1c sep \x85"), (17, "ends with space "), (18, "<|endoftext|> special, tokens. here\nnow"), (None, passage + " more"), (19, "12345 678 !!! ..."), (20, passage), (20, passage), (20, text(40)),
    ]
    rows += [(100 + i, text(rng.randint(1, 80))) for i in range(60)] + [(200 + i, passage + " " + str(i)) for i in range(40)]
    rng.shuffle(rows)
    return rows


ROWS = cases()


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en", "src0", None if t is None else len(t), "f", "s", 1, "h", 0) for i, t in ROWS]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def code(tokenizer, text):
    from tokenizers import Tokenizer

    if not hasattr(code, "t"):
        code.t = Tokenizer.from_file(tokenizer)
    return [*code.t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


# ---- exact dedup


def brute_exact():
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    best = {k: min(v) for k, v in groups.items()}
    return groups, best, norm


@pytest.mark.parametrize("few", [1, 2, 64])
def test_exact_dedup(docs, few):
    groups, best, norm = brute_exact()
    out = exact_dedup.keepers(docs, few=few)
    want = sorted(((i, best[norm(t)][3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS), key=repr)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert out.filter("kept").count() == len(groups)
    assert out.filter("kept and not (doc_id <=> keep_id)").count() == 0


def test_exact_dedup_rows(docs, empty):
    groups, best, norm = brute_exact()
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(groups) and {norm(r["text"]) for r in rows} == set(groups)
    assert all(r["doc_id"] == best[norm(r["text"])][3] for r in rows)
    assert exact_dedup.keepers(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_one_text_in_most_rows(spark):
    """A text with nine tenths of all rows lies in several ranges and runs."""
    rows = [(i, "c o p y" + " " * (i % 7)) for i in range(900)] + [(900 + i, f"text {i}") for i in range(100)] + [(None, "copy")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    runs = exact_dedup._runs(docs, "doc_id", "text", 1).filter("hot").select("salt", "run", "place").distinct().collect()
    assert len({r["salt"] for r in runs}) > 3 and sum(r["place"] == 1 for r in runs) == len({r["salt"] for r in runs})
    out = exact_dedup.keepers(docs, few=1)
    copies = out.filter("group_size = 950").collect()
    assert len(copies) == 950 and {r["keep_id"] for r in copies} == {6} and [r["doc_id"] for r in copies if r["kept"]] == [6]
    assert out.filter("group_size = 1 and kept").count() == 100
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs, few=1).collect()) == [6, *range(900, 1000)]


def test_rows_that_go_are_joined_if_many(docs, monkeypatch):
    few = got(exact_dedup.deduplicate(docs), *docs.columns)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert got(exact_dedup.deduplicate(docs), *docs.columns) == few


# ---- SimHash


def brute_fp(text):
    import xxhash

    w = SPACE.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, radius=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, empty):
    fps = [brute_fp(t) for _, t in ROWS]
    roots = brute_groups(fps)
    least = {}
    for (i, _), r in zip(ROWS, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(ROWS, fps, roots)), key=repr)
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("f"), "component_id")
    assert got(out, "doc_id", "f", "component_id") == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_pivot_tables_decide_what_is_compared(monkeypatch):
    """Without the tables more pairs are compared bit by bit, and the links are the same."""
    rng = random.Random(5)
    key = np.repeat(np.arange(300), 10)[:, None]
    fp = np.array([rng.getrandbits(64) for _ in range(len(key))], np.uint64)
    fp[1::10] = fp[::10] ^ np.uint64(6)
    table = np.bitwise_count(fp[:, None] ^ simhash.pivots()[None, :]).astype(np.uint8)
    seen = []

    def spy(a, b, radius, real=simhash.survive):
        out = real(a, b, radius)
        seen.append((out.size, int(out.sum())))
        return out

    monkeypatch.setattr(simhash, "survive", spy)
    links = simhash._links(key, fp, table, 4)
    met, passed = map(sum, zip(*seen))
    assert met == 300 * 45 and 300 <= passed < met / 10
    monkeypatch.setattr(simhash, "survive", lambda a, b, radius: np.ones(len(a), bool))
    again = simhash._links(key, fp, table, 4)
    assert sorted(zip(*links)) == sorted(zip(*again)) and len(links[0]) == 300


@pytest.mark.parametrize("chunk", [3, 50, 4096])
def test_simhash_links_in_dense_buckets(spark, chunk):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    fps = sorted(near)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    df = df.withColumn("table", simhash.pivot_table())
    for r in df.limit(20).collect():
        assert list(r["table"]) == [(int(p) ^ r["fp"] % (1 << 64)).bit_count() for p in simhash.pivots()]
    edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.link(df, chunk=chunk).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    place = {f: i for i, f in enumerate(fps)}
    roots, parent = brute_groups(fps), list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[root(place[u])] = root(place[v])
    mine = [root(i) for i in range(len(fps))]
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(5, 5), (7, 6)]
    df = spark.createDataFrame(edges, "u long, v long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    want = sorted((x, root(x)) for x in parent)
    assert sorted((r["node"], r["root"]) for r in components.components(df).collect()) == want
    assert components.components(df.limit(0)).count() == 0


# ---- substring dedup


def brute_substrings():
    split = [SPACE.findall(t or "") for _, t in ROWS]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for (i, _), w in zip(ROWS, split):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), key(i))
    out = []
    for (i, _), w in zip(ROWS, split):
        cut = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                cut[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut) if not c).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_substring_dedup(spark, docs, empty, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert got(substring_dedup.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings()
        texts = substring_dedup.kept_texts(docs).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in texts), key=repr) == brute_substrings()
        assert substring_dedup.digests(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_automata(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STATES", 40)
    table = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).toArrow()
    u = substring_dedup.Unit(table, 13)
    few = substring_dedup._locate(u, np.zeros(u.hash.size, bool))
    monkeypatch.setattr(substring_dedup, "STATES", 10**9)
    assert (few == substring_dedup._locate(u, np.zeros(u.hash.size, bool))).all() and few.any()
    # every document runs through the automata, and nothing but their matches removes a word
    seen, real = [], substring_dedup._automata

    class Spy:
        def __init__(self, machine):
            self.machine = machine

        def iter(self, text):
            seen.append(text)
            return self.machine.iter(text)

    monkeypatch.setattr(substring_dedup, "_automata", lambda *a: map(Spy, real(*a)))
    assert (few == substring_dedup._locate(u, np.zeros(u.hash.size, bool))).all()
    loses = {r for r, a, n in zip(range(len(ROWS)), u.first, u.n_words) if few[a : a + n].any()}
    assert len(seen) > len(loses)  # also those that hold a passage first
    monkeypatch.setattr(substring_dedup, "_automata", lambda *a: iter(()))
    assert not substring_dedup._locate(u, np.zeros(u.hash.size, bool)).any()


@pytest.mark.parametrize("unit_bytes", [1, 3000])
def test_units_by_size(docs, monkeypatch, unit_bytes):
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", unit_bytes * 20)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 20_000)
    assert got(substring_dedup.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings()


def test_words_in_letters():
    words = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    text, n = substring_dedup._spelled(np.unique(words, return_inverse=True)[1], 5000)
    assert n == 3 and len({text[i : i + n] for i in range(0, len(text), n)}) == 5000
    assert all(len(set(text[k::n])) <= 64 for k in range(n)) and not set(text[0::n]) & set(text[1::n])


# ---- decontamination

ITEMS = [(1, ROWS[0][1]), (2, next(t for i, t in ROWS if i == 9)), (3, "one"), (4, None), (5, "!!! ..."), (6, "X Y"), (10, next(t for i, t in ROWS if i == 9)), (10, "duplicate id of an item that occurs nowhere at all in any of the texts"), (7, next(t for i, t in ROWS if i == 7)[500:900])]


def brute_contamination():
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    windows = {}
    for i, t in ITEMS:
        w = low(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in ROWS:
        w, items = low(t), set()
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit[k : k + n] = [True] * n
                    items |= windows[g]
        h = sum(hit)
        out.append((i, len(w), h, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 500, 1])
def test_decontamination(spark, docs, empty, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    if block_bytes == 1:
        bench = bench.filter("item_id in (2, 3)")
        many = decontaminate.decontaminate(docs, bench, block_bytes=200)
        assert got(many, *columns) == got(decontaminate.decontaminate(docs, bench), *columns)
        return
    assert got(decontaminate.decontaminate(docs, bench, block_bytes=block_bytes), *columns) == brute_contamination()
    assert decontaminate.decontaminate(empty, bench).count() == 0
    none = decontaminate.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count_if("contaminated")).first()
    assert tuple(none) == (0, 0)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in brute_contamination())


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "p q " + " ".join(f"w{i}" for i in range(30)) + " r"), (2, " ".join(f"w{i}" for i in range(10)))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "s " + " ".join(f"w{i}" for i in range(3, 25)) + " t")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()] == [(1, "5", 5, 1, 22)]


# ---- tokens and packing


@pytest.mark.parametrize("bits", [6, 12, 21])
def test_cached_bpe(tokenizer, bits):
    from array import array

    rng = random.Random(5)
    parts = [*"ab'sZé×1 \n\t.,!\x01\x1c\xa0\x85日<|>\0", "  ", "<|endoftext|>", " it's", "'ll", ", ", ". ", ".\n", ",\n", "é, ", "×. ", "word, next. Line\nbreak", "y" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [t or "" for _, t in ROWS]
    enc = bpe.CachedBPE(tokenizer, bits)
    want = [array("I", e.ids).tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and enc.encode(texts) == want
    for k in range(0, len(texts), 101):
        assert enc.encode(texts[k : k + 101]) == want[k : k + 101]
    assert enc.filled <= 1 << bits


@pytest.mark.parametrize("top", [1, 2, 300, 70000, 2**31, 2**62])
@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 3000])
def test_simple8b(n, top):
    rng = np.random.default_rng(n)
    v = rng.integers(0, top, n, dtype=np.uint64)
    v[: n // 3] = 0
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, n) == v).all()
    if n > 200:  # a value beyond 60 bits takes an escape
        v[n // 2] = np.uint64(2**63 + 5)
        words, offsets = simple8b.encode(v)
        assert (simple8b.decode(words, offsets, n) == v).all()
    if top <= 2**31:
        ids = v.astype("<u4")
        assert (simple8b.unpack(simple8b.pack(ids)) == ids).all()


@pytest.mark.parametrize("shard_ids", [1, 100, 1 << 17])
def test_token_files(spark, docs, empty, tokenizer, shard_ids, tmp_path):
    path = str(tmp_path / "t")
    common.prepare(spark)
    token_files.write_token_files(docs, path, tokenizer, shard_ids=shard_ids)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t in order:
        ids = code(tokenizer, t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got(token_files.read_digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    back = {r["start"]: bytes(r["ids"]) for r in token_files.read_tokens(spark, path).collect()}
    assert all(crc(np.frombuffer(back[s], "<u4")) == c for _, s, _, c in want)
    token_files.write_token_files(empty, str(tmp_path / "e"), tokenizer)
    assert token_files.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, empty, tokenizer):
    out = packing.pack(docs, tokenizer).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 for r in out)
    batches = {}
    for r in out:
        batches.setdefault(r["batch_id"], []).append(r)
    for b in batches.values():  # one length, sequences that follow each other
        assert len({r["length"] for r in b}) == 1 and [r["sequence_id"] for r in b] == list(range(b[0]["sequence_id"], b[0]["sequence_id"] + len(b)))
        assert sum(r["length"] for r in b) <= packing.BATCH_IDS
    assert len(batches) < len(out) / 2
    whole = {}
    for r in out:
        assert crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for i, t in ROWS:
        if i != 20:
            parts = sorted(whole[i])
            assert b"".join(p[1] for p in parts) == np.array(code(tokenizer, t), "<u4").tobytes()
            assert parts[0][2] * 4 == sum(len(p[1]) for p in parts)
    assert sum(len(r["ids"]) for r in out) == 4 * sum(len(code(tokenizer, t)) for _, t in ROWS)
    assert packing.pack(empty, tokenizer).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, tokenizer, max_length=1000)


# ---- secrets


def brute_secrets(text):
    text = text or ""
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m.group(g)) >= least)
    return [sum(s[1] == k for s in spans) for k in range(3)], ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)


def test_secrets(spark, docs, empty):
    rng = random.Random(11)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    texts = [None, "", f"Token: '{base(20)}' and API_KEY={base(9)}, apikey = short", f"é日 {hexa(40)} {hexa(31)} x{hexa(32)}y {hexa(33)}ABC", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIASHORT AKIA0123456789AB", f"secret=password={base(12)} token=token=abcdefgh", f"passwd:{hexa(64)}", 'password = "abcdefg" password="abcdefgh"', "token" * 50 + "=abcdefghij", f"{hexa(40)}{hexa(5)} {hexa(40)}"]
    planted = [f"the words {base(40)} and on" for _ in range(60)]
    prose = ["some-long-hyphenated-words-in-a-row here2there3again4now5x " * 2] * 20
    rows = list(enumerate(texts + planted + prose)) + [(500 + k, t) for k, (_, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in secrets_scan.digests(df).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        n, s = brute_secrets(t)
        r = out[i]
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) == (n, hashlib.sha256(s.encode()).hexdigest()), (t, s, r["spans"])
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == [x for x in s.split(",") if x]
    found = sum("random" in out[i]["spans"] for i, t in rows if t in planted)
    assert found >= 50
    assert not any("random" in out[i]["spans"] for i, t in rows if t in prose)
    assert secrets_scan.digests(empty).count() == 0


# ---- licenses


def test_licenses(spark, docs, empty):
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(n))
    t = license_scan.TEMPLATES
    rows, want = [], set()
    for i in range(120):
        name = sorted(t)[i % len(t)]
        body = t[name].upper() if i % 3 == 0 else t[name].replace(" ", "\n  ")
        rows.append((i, f"{fill(rng.randint(0, 200))} {body} {fill(rng.randint(0, 90))}"))
        want.add((i, name))
    half = t["mit-grant"].split()
    rows += [(900, " ".join(half[: len(half) // 2])), (901, None), (902, ""), (903, " ".join(half[: len(half) * 9 // 10]))]
    want.add((903, "mit-grant"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["template"]) for r in license_scan.scan(df).collect()}
    assert want <= out and (900, "mit-grant") not in out
    for i, name in out - want:  # a short notice may lie in a longer template
        w, v = license_scan._template_words(t[name]), license_scan._template_words(dict(rows)[i])
        own = set(zip(*[w[k:] for k in range(5)]))
        assert len(own & set(zip(*[v[k:] for k in range(5)]))) >= 0.8 * len(own)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0
    assert license_scan.scan(df, {}).count() == 0 and license_scan.scan(df, {"x": "two words"}).count() == 0


# ---- classifiers


def test_language(spark, docs, empty):
    rng = random.Random(4)
    sound = {"aa": ["the", "ing", "er", "th", "ou"], "bb": ["que", "eau", "le", "ré", "oi"], "cc": ["sch", "ung", "der", "ß", "ei"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang := rng.choice(sorted(sound)), rng.randint(3, 60)), lang) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 400"), max_train=300, n_landmarks=40)
    test = langid.predict(df.filter("doc_id >= 400"), model, ["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in test)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! \n"), (4, "²³"), (5, "日本語")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in langid.predict(odd, model, ["doc_id"]).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    letters = [sum(c.isalpha() for c in t or "") for _, t in ROWS]
    assert langid.keep_known(docs, nothing).count() == sum(n > 0 for n in letters)
    kept = langid.keep_known(docs, model)  # en is none of the model's languages
    claims = model.judge([t for _, t in ROWS])[2]
    assert kept.columns == docs.columns and kept.count() == sum(n > 0 and not (n >= langid.JUDGED and c < langid.LEAST) for n, c in zip(letters, claims))


def _right(model, rows):
    """Share of rows predicted right, by language."""
    langs, _ = model.predict([t for _, t, _ in rows])
    out = {}
    for (_, _, lang), found in zip(rows, langs):
        out.setdefault(lang, []).append(lang == found)
    return {lang: sum(x) / len(x) for lang, x in out.items()}


def test_every_script_keeps_its_letters():
    rng = random.Random(5)
    first = {"latin": (97, 26), "greek": (945, 24), "han": (0x4E00, 600), "hangul": (0xAC00, 600), "gothic": (0x10330, 26), "ugaritic": (0x10380, 29)}
    make = lambda lang, n: " ".join("".join(chr(first[lang][0] + rng.randrange(first[lang][1])) for _ in range(4)) for _ in range(n))
    rows = [(i, make(lang, 200 if first[lang][1] > 99 else 3), lang) for i in range(50) for lang in first]
    model = langid.Model([(t, lang) for _, t, lang in rows[:180]])
    assert _right(model, rows[180:]) == dict.fromkeys(first, 1.0)


def test_many_languages():
    rows = [(i, " ".join(chr(0x4E00 + 3 * k + (i + j) % 3) * 2 for j in range(5)), f"l{k:03}") for i in range(2) for k in range(300)]
    model = langid.Model([(t, lang) for _, t, lang in rows[:300]], n_grams=600)
    assert _right(model, rows[300:]) == {f"l{k:03}": 1.0 for k in range(300)}


def test_no_language_is_left_out(spark):
    rows = [(i, " ".join(["abcd efgh"] * 4), "aa") for i in range(300)] + [(1000 + k, " ".join([chr(0x4E00 + k) * 3] * 9), f"l{k:03}") for k in range(220)]
    rows += [(2000 + i, "1 2 3 " * 30 + "αβγ δεζ " * 40, "long") for i in range(5)] + [(3000 + i, "12 34", "none") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, max_chars=100)
    assert model.languages == sorted({lang for _, _, lang in rows} - {"none"})
    assert set(_right(model, [r for r in rows if r[2] != "none"]).values()) == {1.0}


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5) | (x[:, 2] > 1.5)).astype(float)
    m = quality.Trees(n_trees=60).fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # flattened arrays against a walk of each tree
    for r in x[2000:2050]:
        f = m.base
        for t in range(len(m.leaf)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + int(r[m.feature[t, node]] > m.cut[t, node])
            f += m.leaf[t, node - m.feature.shape[1]]
        assert abs(m.predict(r[None, :])[0] - 1 / (1 + np.exp(-f))) < 1e-12


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["stone", "river", "light", "walks", "under"]) for _ in range(rng.randint(20, 80))) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###", "NOW!!", "|"]) for _ in range(rng.randint(5, 80)))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = df.filter("doc_id < 400").select("doc_id", F.col("q").alias("quality"), F.lit(0).alias("toxic")).unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int"))
    model = quality.fit(df, labels)
    out = quality.score(df.filter("doc_id >= 400"), model, ["doc_id", "q"]).collect()
    assert sum(r["predicted"] == r["q"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(docs, model, ["doc_id"]).count() == len(ROWS)
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0)), ["doc_id"]).collect()} == {0.5}
    assert len(quality.features(b"")) == len(quality.features("a é\n b".encode())) == len(quality.NAMES)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns


def test_crc_mod(spark):
    rows = spark.range(50).select("id", common.crc_mod("id", 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
