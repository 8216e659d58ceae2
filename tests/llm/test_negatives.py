"""Hard negatives against all pairs in Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn

KIND = "vec_id long, label int, embedding array<double>"


def brute(rows, every=5, scale=256.0, positives=5, negatives=5, low=80, high=100):
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, lab, v) in enumerate(ok):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for n, (j, m, w) in enumerate(ok) if n != k]
        same = sorted((s, j) for s, j, m in scored if m == lab)[:positives]
        other = sorted((s, j) for s, j, m in scored if m != lab)
        for p, pid in same:
            fit = [(s, j) for s, j in other if low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", rank string, at int").repartition(3)
    out = hn.mine(df, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect())


def vectors(seed, n=220, width=6):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    rows = [(i, rng.randrange(3), [x + rng.gauss(0, 0.4) for x in rng.choice(base)]) for i in range(n)]
    copies = [(1000 + i, rng.randrange(3), rows[3][2]) for i in range(60)]  # many copies tie
    odd = [(5, None, [1.0] * width), (10, 1, None), (15, 1, [math.nan] * width), (20, 1, [math.inf] + [0.0] * (width - 1)), (25, 1, [1.0, None, 1.0]), (None, 1, [1.0] * width), (30, 1, []), (35, 1, [1.0, 2.0]), (40, 2, [0.0] * width)]
    again = [rows[0], rows[0], (rows[0][0], rows[0][1], rows[7][2]), (rows[5][0], (rows[5][1] + 1) % 3, rows[5][2])]  # repeated ids
    return rows + copies + odd + again


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    rows = vectors(seed)
    assert mined(spark, rows) == brute(rows)


def test_many_blocks_and_other_windows(spark):
    rows = vectors(7, 120)
    assert mined(spark, rows, block_bytes=200) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=9, low=50, high=95, scale=100.0) == brute(rows, positives=2, negatives=9, low=50, high=95, scale=100.0)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [float(rng.randrange(-(1 << 27), 1 << 27)) for _ in range(5)]) for i in range(60)]
    assert mined(spark, rows, scale=1.0) == brute(rows, scale=1.0)
    with pytest.raises(ValueError, match="long"):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


def test_tables_without_rows_or_anchors(spark):
    assert mined(spark, [(1, 1, [1.0]), (2, 0, [1.0])]) == []
    empty = spark.createDataFrame([], KIND)
    assert hn.mine(empty, F.col("vec_id") % 5 == 0).collect() == []
    assert hn.mine(empty, F.col("vec_id") % 5 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
