"""Text rules and chunkers against plain statements of the rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunk

CASES = [
    "", " ", "a", "One. Two! Three? Four", "Dr. Smith met Mr. Jones. They spoke e.g. of it. End.", "see https://a.b/c?d=1&e;f now &nbsp; <b>x</b> [edit] {{t|u}} ok",
    "Été à Köln — déjà-vu… “quoted”", "a b c\n\n\td", "x" * 2500, "word " * 600, "A. " * 900, "no stop here\nsecond line\n# head\n", "日本語 テキスト。 次", "!!! ??? ...", "a  b   c",
]


def py_web(t):
    for p in (r"http[s]?://[!$-_a-z]+", r"<[^>]+>", r"\[edit\]", r"\{\{[^}]*\}\}", r"&[a-zA-Z]+;", r"\s+"):
        t = re.sub(p, " ", t)
    return re.sub(r"[^\w\s.!?,;:\-'\"]", "", " ".join(t.split())).strip()


def py_typed(t):
    return re.sub(r"[^\w\s.,!?;:\-()\[\]{}\"'/\\]", "", re.sub(r"\s+", " ", t)).strip()


def py_prose(t):
    return " ".join(re.sub(r"[^\w\s.,!?']", " ", t).split())


def py_sentences(t):
    return [s for x in re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s", t) if (s := x.strip())]


def py_pack(t, least, most):
    out, cur = [], ""
    for s in py_sentences(t):
        if len(cur) + len(s) > most:
            if len(cur) >= least:
                out.append(cur.strip())
            cur = ""
        cur += s + " "
    return out + [cur.strip()] * (len(cur) >= least)


def py_fixed(t, size, overlap):
    if len(t) <= size:
        return [t]
    out, a = [], 0
    while True:
        out.append(t[a : a + size].strip() or None)
        if a + size >= len(t):
            return out
        a += size - overlap


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", expression.alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("spark_rule, rule", [(T.clean_web, py_web), (T.clean_typed, py_typed), (T.clean_prose, py_prose), (T.sentences, py_sentences)])
def test_rules(spark, spark_rule, rule):
    assert column(spark, CASES, spark_rule(F.col("t"))) == [rule(c) for c in CASES]


def test_null_is_empty(spark):
    assert column(spark, [None], T.clean_web(F.col("t"))) == [""]


@pytest.mark.parametrize("least, most", [(50, 2000), (100, 500), (1000, 1000), (0, 10)])
def test_pack(spark, least, most):
    assert column(spark, CASES, chunk.by_sentences(F.col("t"), least, most)) == [py_pack(c, least, most) for c in CASES]


@pytest.mark.parametrize("size, overlap", [(300, 30), (800, 0), (10, 9), (1, 0)])
def test_fixed(spark, size, overlap):
    cases = [c for c in CASES if len(c) < 1000 or size > 100]
    assert column(spark, cases, chunk.fixed(F.col("t"), size, overlap)) == [py_fixed(c, size, overlap) for c in cases]


def test_fixed_rejects_overlap():
    with pytest.raises(ValueError, match="overlap"):
        chunk.fixed(None, 5, 5)


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ab .!\n", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_walk_covers_all(text, size, overlap):
    held = "".join(p for _, p in chunk.walk(text, size, overlap))
    assert set(text.split()) == {w for w in text.split() if w in text}
    assert len(re.sub(r"\s", "", held)) >= len(re.sub(r"\s", "", text))
    for _, p in chunk.walk(text, size, overlap):
        assert p in text and len(p) <= size
    compat = chunk.walk(text, size, overlap, compat=True)
    assert len(compat) >= len(chunk.walk(text, size, overlap)) or not overlap


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_recursive_bounds(text, size, overlap):
    pieces = chunk.recursive(text, size, min(overlap, size - 1))
    assert all(0 < len(p) <= size for p in pieces)
    assert all(p in text for p in pieces)
    assert len(re.sub(r"\s", "", "".join(pieces))) >= len(re.sub(r"\s", "", text))


def py_recursive(t, size, overlap, separators):
    if len(t) <= size or not t.strip():
        return [t.strip()] if t.strip() else []
    k = min(i for i, x in enumerate(separators) if x in t)
    cut = separators[k]
    parts = re.findall(rf"(?s).*?{re.escape(cut)}|.+", t) if cut else list(t)
    wide = [bool(cut) and len(p) > size for p in parts]
    out, i = [], 0
    while i < len(parts):
        if wide[i]:
            out += py_recursive(parts[i], size, overlap, separators[k + 1 :] or ("",))
            i += 1
            continue
        j = max(j for j in range(i + 1, len(parts) + 1) if not any(wide[i:j]) and sum(map(len, parts[i:j])) <= size)
        out.append("".join(parts[i:j]).strip())
        if j == len(parts):
            break
        i = j if wide[j] else min(m for m in range(i + 1, j + 1) if sum(map(len, parts[m:j])) <= overlap and sum(map(len, parts[m : j + 1])) <= size)
    return [x for x in out if x]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_recursive_by_indices(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert chunk.recursive(text, size, overlap) == py_recursive(text, size, overlap, chunk.SEPARATORS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.,é \n", max_size=200), st.integers(2, 20), st.integers(0, 10))
def test_token_windows_and_two_stage(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]
    starts = [a for a in range(0, max(1, len(spans)), size - overlap) if a == 0 or a + overlap < len(spans)] if spans else []
    want = [text[spans[a][0] : spans[min(a + size, len(spans)) - 1][1]] for a in starts]
    assert chunk.token_windows(text, size, overlap) == want
    assert chunk.two_stage(text, 30, size, overlap) == [w for p in py_recursive(text, 30, 0, chunk.SEPARATORS) for w in chunk.token_windows(p, size, overlap)]


def test_python_chunks_isolate_errors(spark):
    df = spark.createDataFrame([(1, "abc def"), (2, None), (3, "")], "doc_id long, t string")
    got = {(r["doc_id"], r["chunk"]) for r in chunk.python_chunks(df, "t", ["doc_id"]).collect()}
    assert got == {(1, "abc def")}
    bad = chunk.python_chunks(df, "t", ["doc_id"], size="x").collect()
    assert bad and all(r["error"] for r in bad)


def test_helpers(spark):
    assert column(spark, ["Ann Lee Ray", "Bob", " "], T.first_name(F.col("t"))) == ["Ann", "Bob", ""]
    assert column(spark, ["Ann Lee Ray", "Bob", " "], T.last_name(F.col("t"))) == ["Lee Ray", "", ""]
    assert column(spark, ["abcdef", "abc"], T.truncate(F.col("t"), 3)) == ["abc...", "abc"]
    assert column(spark, ['x {"a":1} y', "none"], T.json_in_text(F.col("t"))) == ['{"a":1}', None]
    assert column(spark, ["a ### Response: b ", "c"], T.after(F.col("t"), "### Response:")) == ["b", "c"]
    assert column(spark, ["# A\nx" + "y" * 60 + "\n\nshort\n# B\n" + "z" * 60], chunk.heading_sections(F.col("t"))) == [["# A\nx" + "y" * 60, "# B\n" + "z" * 60]]


def py_sections(t):
    out = []
    for s in map(str.strip, t.split("\n\n")):
        if len(s) > 1000:
            cur = ""
            for w in s.split():
                cur += w + " "
                if len(cur) >= 800:
                    out.append(cur.strip())
                    cur = ""
            out += [cur.strip()] if cur else []
        elif len(s) > 100:
            out.append(s)
    return out


def test_long_sections_are_split(spark):
    texts = [*CASES, "\n\n".join(["x" * 100, "y" * 101, "word " * 200, "some words " * 300, "z" * 5000]), "ab " * 266 + "c " * 400, "a" * 399 + " " + "b" * 399 + " " + "c " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r["i"]: r["c"] for r in df.select("i", chunk.raw_sections(F.col("t")).alias("c")).collect()} == {i: py_sections(t) for i, t in enumerate(texts)}


def test_no_section_is_lost(spark, data):
    from corpusloom import queries as q

    found = sorted((r["doc_id"], r["chunk"]) for r in q.QUERIES["raw_text_sections"](spark, data).collect())
    texts = q.docs(spark, data).select("doc_id", "text").collect()
    assert any(len(s) > 1000 for r in texts for s in r["text"].split("\n"))
    assert found == sorted((r["doc_id"], c) for r in texts for c in py_sections(r["text"].replace("\n", "\n\n")))
