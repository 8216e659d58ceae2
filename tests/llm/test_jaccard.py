"""The n-gram Jaccard join against all pairs."""

import random

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import jaccard_join as jj
from corpusloom.llm import queries as q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def shingles(text):
    w = [x for x in "".join(" " if c in SPACES else c for c in (text or "").translate(LOW)).split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, t=80):
    """All pairs that share a shingle, by an inverted index without any filter."""
    sets = [shingles(x) for _, x in rows]
    at, parent = {}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in at.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            at[g].append(i)
        for j, o in seen.items():
            if 100 * o >= t * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def planted(seed, n=60):
    """Families of copies at distances around the threshold, chains, boilerplate, short texts and odd rows."""
    rng = random.Random(seed)
    plate = [f"plate{k}" for k in range(40)]
    rows = []
    for f in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 20, 60, 150, 300]))] + (plate if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 12)):
            w = edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
            if rng.random() < 0.2:
                base = w  # a chain
            if rng.random() < 0.2:
                w = w + [f"tail{rng.randrange(50)}" for _ in range(rng.randrange(30))]
            rows.append((len(rows), (" " if rng.random() < 0.8 else "\n\t").join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "ONE"), (9006, "é É"), (9007, "É É"), (5, "same id other text"), (5, "same id other text"), (None, "no id at all"), (None, rows[0][1])]


@pytest.mark.parametrize("seed", range(4))
def test_families(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, token int, sid int").repartition(5)
    assert result(jj.similar_groups(df)) == brute(rows)


@pytest.mark.parametrize("threshold", [50, 90, 100])
def test_thresholds(spark, threshold):
    rows = planted(11, 30)
    assert result(jj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold)) == brute(rows, threshold)


def test_one_large_family_in_chunks(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.002, 0.01, 0.02])))) for i in range(400)]
    assert result(jj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk=32)) == brute(rows)


def test_heavy_tokens_are_dealt(spark, monkeypatch):
    """Tokens of heavy cells skip the test for single entries."""
    rows = planted(21, 25)
    plain = jj._entries
    monkeypatch.setattr(jj, "_entries", lambda *args: plain(*args[:-1], 1))
    assert result(jj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("bits", [1, 6])
def test_digests_that_share_a_half(spark, bits):
    rows = planted(31, 15)
    assert result(jj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits)) == brute(rows)


def test_empty_tables_and_very_long_texts(spark):
    assert result(jj.similar_groups(spark.createDataFrame([], "doc_id long, text string"))) == []
    long = [f"w{k % 977}x{k % 1009}" for k in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-7000])), (3, " ".join(long[: len(long) // 2])), (4, "x" * 3_000_000)]
    assert result(jj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_whole_table(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet").to_pylist()]
    assert result(q.op12_jaccard_join(spark, data)) == brute(rows)
