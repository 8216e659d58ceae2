"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import os
import zlib

import pytest
from compare import duck, rows
from test_ops import brute_fp, brute_groups, brute_secrets, code, crc

from corpusloom.llm import queries as q


@pytest.fixture(scope="module")
def table(data):
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, data, name):
    assert rows(q.QUERIES[name](spark, data)) == duck(data, q.ORACLES[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))


def test_tokens(spark, data, table):
    start, want = 0, {}
    for i in sorted(table):
        ids = code(q.tokenizer(), table[i])
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.op3_token_files(spark, data).collect()} == want


def test_packing(spark, data, table):
    pieces = {}
    for r in q.op8_packing(spark, data).collect():
        assert r["length"] <= 1024 and r["length"].bit_count() == 1 and r["offset"] == 0
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in table.items():
        ids, at = code(q.tokenizer(), t), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)


def test_simhash(spark, data, table):
    ids = sorted(table)
    fps = [brute_fp(table[i]) for i in ids]
    roots, least = brute_groups(fps), {}
    for i, r in zip(ids, roots):
        least.setdefault(r, i)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op7_simhash_near_dedup(spark, data).collect()} == {i: (f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots)}


def test_secrets(spark, data, table):
    for r in q.op6_secret_scan(spark, data).collect():
        n, spans = brute_secrets(table[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == spans


@pytest.mark.parametrize("name, held, label, column, least", [("op1_quality_classifier", (5, 0), "quality", "predicted", 0.95), ("op5_language_id", (4, 2), "lang", "lang_pred", 0.97)])
def test_held_out(spark, name, held, label, column, least):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    truth = spark.read.parquet(f"{d}/{'labels' if label == 'quality' else 'documents'}.parquet").select("doc_id", label)
    out = q.QUERIES[name](spark, d).join(truth, "doc_id").collect()
    test = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % held[0] == held[1]) for r in out)
    assert sum(r[label] == r[column] for r in test) >= least * len(test)


def test_pipeline(spark, data, table):
    import re

    import corpus_pipeline as p

    from corpusloom.llm import langid

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stated, model = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}, langid.fit(docs)
    kept = {}
    for (i, t), lang, score, claim in zip(table.items(), *model.judge(list(table.values()))):
        n = sum(c.isalpha() for c in t or "")
        if n and not (n >= 20 and claim < 0.1) and not (stated[i] in model.languages and stated[i] != lang and score >= 0.8):
            kept[i] = t
    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    kept = {i: kept[i] for i in (min(v)[1] for v in groups.values())}
    ids = sorted(kept)
    roots, first = brute_groups([brute_fp(kept[i]) for i in ids]), {}
    for i, r in zip(ids, roots):
        first.setdefault(r, i)
    kept = {i: kept[i] for i in first.values()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    windows = {}
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = low(r["text"])
        n = min(13, len(w))
        windows.setdefault(n, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    clean = []
    for i in sorted(kept):
        w = low(kept[i])
        hit = set()
        for n, found in windows.items():
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in found:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(i)
    out = {}
    for r in p.run(spark, data).collect():
        out.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert sorted(out) == clean
    for i in clean:
        ids = b"".join(x for _, x in sorted(out[i]))
        assert len(ids) == 4 * len(code(q.tokenizer(), kept[i])) and zlib.crc32(ids) == crc(code(q.tokenizer(), kept[i]))
    assert [n for n, _ in p.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"] and p.ORACLE_SQL is None
