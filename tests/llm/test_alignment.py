"""Cross-tokenizer alignment against plain tokenizing and counting."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import queries as q
from corpusloom.llm import token_alignment as ta

LETTERS = "a b  c,.é\n\t▁日xyz 0<s>|endoftext|>　ﬁ\x00😀"


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(q.tokenizer())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=q.tokenizer("piece_bpe_32k.model"))


def byte_of():
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out, more = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(more)], more = b, more + 1
    return out


def brute(models, rows):
    """rows of (doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    a, b = models
    back = byte_of()
    links, out = [], []
    for _, text in rows:
        own, groups = [], []
        if text:
            ta_ = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb_ = []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                tb_.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in ta_) == b"".join(x for _, x in tb_) == (" " + text).encode():
                ea, eb, at = {}, {}, 0
                for i, x in ta_:
                    at += len(x)
                    ea[at] = i
                at = 0
                for i, x in tb_:
                    at += len(x)
                    eb[at] = i
                low = 0
                for e in sorted(ea.keys() & eb.keys()):
                    groups.append(",".join(str(ea[k]) for k in sorted(ea) if low < k <= e) + "|" + ",".join(str(eb[k]) for k in sorted(eb) if low < k <= e))
                    own.append((ea[e], eb[e]))
                    low = e
                out.append([len(ta_), len(tb_), groups])
            else:
                out.append([0, 0, []])
        else:
            out.append([0, 0, []])
        links.append(own)
    n = Counter(x for own in links for x in own)
    top = {}
    for (_, y), c in n.items():
        top[y] = max(top.get(y, 0), c)
    return sorted(
        (str(i), na, nb, len(g), len(own), sum(n[x] == top[x[1]] for x in own), sum(n[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for (i, _), (na, nb, g), own in zip(rows, out, links)
    )


def result(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def odd_rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, " "), (903, "   "), (904, "end "), (905, "<|endoftext|>"), (906, "a▁b"), (907, "▁"), (None, "no id here"), (3, "same id"), (3, "same id"), (908, "word " * 3000), (909, "x" * 5000)]


def test_whole_table(spark, data, models):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet").to_pylist()]
    got = q.op11_token_alignment(spark, data)
    assert result(got) == brute(models, rows)


@pytest.mark.parametrize("top, size", [(1 << 19, 1 << 18), (40, 7), (0, 64)])
def test_odd_texts_rare_pairs_and_small_slices(spark, models, top, size):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pair int, row int").repartition(3)
    assert result(ta.digests(df, q.tokenizer(), q.tokenizer("piece_bpe_32k.model"), top, size)) == brute(models, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert result(ta.digests(df, q.tokenizer(), q.tokenizer("piece_bpe_32k.model"))) == []


def test_groups_are_kept(spark):
    df = spark.createDataFrame([(1, "Hello wonderful world")], "doc_id long, text string")
    r = ta.align(df, q.tokenizer(), q.tokenizer("piece_bpe_32k.model"), keep_groups=True).filter("pair is null").first()
    assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] and r["groups"].count(";") == r["n_groups"] - 1


@pytest.mark.parametrize("size", [8, 9])
def test_word_table_equals_the_library(models, size):
    rng = random.Random(size)
    texts = [" " + "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for coder, plain in ((ta.PlainBPE(q.tokenizer(), size), lambda x: models[0].encode(x, add_special_tokens=False).ids), (ta.CachedPieces(q.tokenizer("piece_bpe_32k.model"), size), lambda x: models[1].encode(x[1:]))):
        assert [x for x in map(list, map(lambda b: memoryview(b).cast("I"), coder.encode(texts)))] == [plain(x) for x in texts]
