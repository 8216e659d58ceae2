"""Statistics, models and very long texts against plain computations."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import ROWS, SPACE, brute_fp, brute_secrets, code, crc

from corpusloom.llm import decontaminate, exact_dedup, langid, license_scan, packing, quality, secrets_scan, simhash, substring_dedup, token_files
from corpusloom.llm import queries as q

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


# ---- secrets


def tail(z):
    z = max(-30.0, min(30.0, z))
    return 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.070565992 * z**3)))


def plain_battery(a, x):
    n = len(x)
    chi = sum(c * c for c in Counter(x).values()) * a / n - n
    df = a - 1
    p_chi = tail((max(chi / df, 1e-9) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [2 * c >= a for c in x]
    h = sum(high)
    if h in (0, n):
        return 0.0
    runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
    mu = 2 * h * (n - h) / n + 1
    p_runs = 2 * tail(abs(runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9)))
    m = sum(x) / n
    lag = sum((u - m) * (v - m) for u, v in zip(x, x[1:]))
    p_serial = 2 * tail(abs(lag / max(sum((u - m) ** 2 for u in x), 1e-9)) * math.sqrt(n))
    return 1 - (1 - min(1.0, p_chi, p_runs, p_serial)) ** 3


def test_battery(spark):
    rng = random.Random(1)
    rows = [(a, [rng.randrange(a) if rng.random() < 0.8 else k % a for k in range(rng.randint(20, 90))]) for a in (10, 16, 26, 32, 36, 52, 64) for _ in range(20)] + [(16, [3] * 20), (64, [63, 0] * 15)]
    df = spark.createDataFrame(rows, "a int, x array<int>")
    for r in df.select("a", "x", secrets_scan._battery(F.col("a"), F.col("x")).alias("p")).collect():
        assert abs(r["p"] - plain_battery(r["a"], r["x"])) < 1e-9


def test_false_discoveries(spark):
    """Of a mixture of random tokens and tokens of text, what is reported holds few of text; without random ones nothing is."""
    rng = random.Random(3)
    words = "report final draft version update river market price signal window packet server branch stable summer winter".split()
    text = lambda: "-".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(6))[:40].strip("-")
    noise = lambda: "".join(rng.choice(BASE64) for _ in range(40))
    rows = [(i, f"see {noise()} here") for i in range(300)] + [(1000 + i, f"see {text()} here") for i in range(900)]
    out = secrets_scan.digests(spark.createDataFrame(rows, "doc_id long, text string")).filter("spans <> ''").collect()
    wrong = sum(r["doc_id"] >= 1000 for r in out)
    assert len(out) - wrong >= 200 and wrong <= 0.05 * len(out)
    assert secrets_scan.digests(spark.createDataFrame(rows[300:], "doc_id long, text string")).filter("spans <> ''").count() <= 9


WORDS = "report final draft version update river market price signal window packet server branch stable summer winter the and of to in is that for it with as was on be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house world going want school important until form food keep children feet land side without boy once animals life enough took sometimes four head above kind began almost live page got earth need far hand high year mother light parts country father let night following picture being study second eyes soon times story boys since white days ever paper hard near sentence better best across during today others however sure means knew it try told young miles sun ways thing whole hear example heard several change answer room sea against top turned learn point city play toward five using himself usually".split()


def text_token(rng, a, n):
    """A token of text in the alphabet of `a`, as _TEXT_ABOVE has them."""
    word = lambda: rng.choice(WORDS)
    numbered = lambda *more: word() + rng.choice(["", "", str(rng.randint(0, 99)), *more])
    if a == 10:
        dates = "".join(f"{rng.randint(2000, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}{rng.randint(0, 23):02d}{rng.randint(0, 59):02d}" for _ in range(9))
        round_ = str(rng.randint(1, 99)) + "0" * rng.randint(4, 12) + str(rng.randint(1, 10**6)).zfill(6) + "0" * 90
        return rng.choice([dates, round_, "".join(str(i % 10) for i in range(rng.randint(0, 9), 120))])[:n]
    if a == 16:
        return "".join(c if c in "abcdef" else rng.choice("0000012") for c in "".join(word() for _ in range(60)))[:n]
    if a in (26, 32, 52):
        shape = {26: str.lower, 32: str.upper, 52: str.capitalize}[a]
        return "".join(shape(word()) for _ in range(60))[:n]
    if a == 36:
        return "".join(numbered() for _ in range(60))[:n]
    sep = rng.choice("++/+")
    joined = [sep.join(word() for _ in range(14)), sep.join(numbered(str(rng.randint(1990, 2030))) for _ in range(14)), "".join(word().capitalize() for _ in range(20)), word() + "".join(word().capitalize() for _ in range(20)), sep.join(word().upper() if rng.random() < 0.3 else word() for _ in range(14))]
    return rng.choice(joined)[:n]


def test_text_tokens():
    """The shares of text above the cuts hold, a lone token of text is reported in one of twenty cases at most, a lone key nearly always where the tests are strong."""
    rng = random.Random(15)
    alphabet = {a: {c: i for i, c in enumerate(x)} for a, x in secrets_scan._ALPHABET.items()}
    edges = (*secrets_scan._LENGTHS, 91)
    found = {}
    for a, codes in alphabet.items():
        for k in range(2, 5):
            text, keys = [], []
            while len(text) < 300:
                t = text_token(rng, a, rng.randint(edges[k], edges[k + 1] - 1))
                if len(t) >= edges[k] and all(c in codes for c in t):
                    text.append(plain_battery(a, [codes[c] for c in t]))
                    keys.append(plain_battery(a, [rng.randrange(a) for _ in range(len(t))]))
            for c, share in zip(secrets_scan._CUTS, secrets_scan._TEXT_ABOVE[a][k]):
                assert abs(sum(p > c for p in text) / 300 - share) <= 0.02 + 3 * math.sqrt(max(share, 0.001) / 300), (a, k, c)
            lone = lambda p: (c := secrets_scan.cut_of(a, k, 1, int(p > 0.5), [int(p > x) for x in secrets_scan._CUTS])) is not None and p > c
            assert sum(map(lone, text)) <= 0.05 * 300 + 8
            found[a, k] = sum(map(lone, keys)) / 300
    assert all(x >= 0.5 for k, x in found.items() if k != (36, 2)), found  # base36 below 48 characters: a lone one is never told from text
    assert all(found[a, k] >= 0.88 for a, k in found if k == 4 or a in (10, 16, 52, 64) or (a, k) == (32, 3)), found


def test_one_key_in_a_table(spark):
    rng = random.Random(21)
    rows = [(i, "see " + "".join(rng.choice(BASE64) for _ in range(40)) + " here") for i in range(12)]
    got = sum(secrets_scan.digests(spark.createDataFrame([r], "doc_id long, text string")).filter("spans like '%random%'").count() for r in rows)
    assert got >= 10


def test_encodings(spark):
    rng = random.Random(9)
    kinds = {"0123456789": 10, "0123456789abcdef": 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 26, BASE64[26:62]: 36, BASE64[:52]: 52, BASE64: 64}
    rows = [(1000 * k + i, "see " + "".join(rng.choice(a) for _ in range(31 if kinds[a] in (10, 16) else 60)) + " here") for k, a in enumerate(kinds) for i in range(150)]
    found = Counter(r["doc_id"] // 1000 for r in secrets_scan.digests(spark.createDataFrame(rows, "doc_id long, text string")).filter("spans like '%random%'").collect())
    assert all(found[k] >= 75 for k in range(len(kinds))), found


def test_many_secrets(spark):
    text = " ".join(f"token={'abcdefgh'[: k % 9]}{k:08d}" for k in range(20_000)) + " é " + "ab" * 16
    r = secrets_scan.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    n, spans = brute_secrets(text)
    assert [r["n_assign"], r["n_access"], r["n_hex"]] == n and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


# ---- licenses


def brute_licenses(rows, templates, least=0.8):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for name, t in templates.items():
        w = words(t)
        m = min(5, len(w))
        if not m:
            continue
        own = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        step = 2 * 2 ** (len(own).bit_length() - 1)
        for i, text in rows:
            v = words(text)
            s = [tuple(v[k : k + m]) for k in range(len(v) - m + 1)]
            last = max(0, -(-(len(s) - 2 * step) // step))
            for k in range(last + 1):
                held = own & set(s[k * step : k * step + 2 * step])
                if len(held) / len(own) >= least:
                    out.add((i, name, k * step, min(j for j in range(k * step, len(s)) if s[j] in own), round(len(held) / len(own), 9)))
    return out


def test_licenses_of_every_length(spark):
    rng = random.Random(6)
    templates = {"all": "All rights reserved.", "two": "Public Domain!", "one": "WTFPL", "none": " -- ", "four": "do as you like", **dict(sorted(license_scan.TEMPLATES.items())[:5])}
    fill = ["alpha", "beta", "gamma", "you", "rights", "public"]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(fill) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            body = rng.choice(list(templates.values())).split()
            drop = rng.randrange(len(body)) if len(body) > 25 and rng.random() < 0.4 else None
            parts += [" ".join(x for k, x in enumerate(body) if k != drop), " ".join(rng.choice(fill) for _ in range(rng.randint(0, 30)))]
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "wtfpl")]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    want = brute_licenses(rows, templates)
    mine = {(r["doc_id"], r["template"], r["window_start"], r["first_word"], round(r["containment"], 9)) for r in out}
    assert len(mine) == len(out) and mine == want
    assert {n for _, n, *_ in mine} >= {"all", "two", "one", "four"}


def test_many_license_templates(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    templates = {f"t{i}": " ".join(rng.choices(words, k=rng.choice([3, 9, 30, 90, 400]))) for i in range(400)}
    rows = [(i // 2, " ".join([*rng.choices(words, k=rng.randint(0, 900)), templates[f"t{rng.randrange(400)}"], *rng.choices(words, k=20)])) for i in range(60)]
    rows += rows[:5]  # repeated rows are scanned each by itself
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates)
    mine = sorted((r["doc_id"], r["template"], r["window_start"], r["first_word"], round(r["containment"], 9)) for r in out.collect())
    assert mine == sorted(x for row in rows for x in brute_licenses([row], templates))
    with pytest.raises(ValueError):
        license_scan.scan(out, {"long": "a license " * (license_scan.MAX_TEMPLATE_CHARS // 9)})


# ---- quality


def plain_features(text):
    words, lines, n = text.split(), text.split(b"\n"), len(text)
    share = lambda f: sum(map(f, text)) / n
    m = max(1, len(words))
    freq = Counter(words)
    entropy = lambda c: -sum(v / sum(c.values()) * math.log2(v / sum(c.values())) for v in c.values())
    upper, lower, digit, high = (lambda c: 65 <= c <= 90), (lambda c: 97 <= c <= 122), (lambda c: 48 <= c <= 57), (lambda c: c >= 128)
    marks = b".,;:!?|#$%&*@-_=+/\\\"'()<>[]{}~^`"
    visible = sum(not (c == 32 or 9 <= c <= 13) for c in text)
    size = [len(w) for w in words] or [0]
    long = [len(x) for x in lines]
    spread = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v))
    top = sorted(freq.values(), reverse=True)[:10]
    return [
        math.log1p(n), math.log1p(len(words)), share(upper), share(lower), share(digit), share(high), share(lambda c: c == 32), share(lambda c: c == 10),
        sum(upper(c) or lower(c) or high(c) for c in text) / max(1, visible), entropy(Counter(text)), *(1000 * text.count(bytes([k])) / n for k in marks),
        sum(size) / len(size), spread(size), math.log1p(max(size)), len(freq) / m, (top or [0])[0] / m, sum(top) / m, sum(x <= 3 for x in size) / m if words else 1.0,
        sum(w.isupper() and len(w) > 1 for w in words) / m, sum(upper(w[0]) for w in words) / m, sum(w.isdigit() for w in words) / m, sum(w[-1] in marks for w in words) / m,
        sum(w.isalpha() for w in words) / m, entropy(freq) if words else 0.0,
        math.log1p(len(lines)), math.log1p(sum(long) / len(long)), math.log1p(spread(long)), len(set(lines)) / len(lines), sum((c - 1) * len(x) for x, c in Counter(lines).items()) / n,
        max(Counter(lines).values()) / len(lines), sum(x < 20 for x in long) / len(lines), sum(c in b".!?" for c in text) / m, 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
    ]


def test_statistics():
    for _, t in ROWS:
        if t:
            assert np.allclose(quality.features(t.encode()), plain_features(t.encode()), atol=1e-9), t[:60]
    assert quality.features(b"") == [0.0] * len(quality.NAMES)


def test_greedy_splits():
    """The first tree against an exhaustive search of every cut; equal gains go to the first feature and cut."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, size=(60, 3)).astype(float)
    x[:, 2] = x[:, 0]  # ties
    y = ((x[:, 0] > 2) & (x[:, 1] > 0)).astype(float)
    m = quality.Trees(n_trees=1, depth=2, rate=1.0).fit(x, y)
    p = np.full(len(y), np.clip(y.mean(), 0.01, 0.99))
    g, h = p - y, p * (1 - p)

    def best(rows):
        found = (1e-6, None)
        for j in range(3):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 255)[1:-1])):
                left = rows[x[rows, j] <= cut]
                right = rows[x[rows, j] > cut]
                if min(h[left].sum(), h[right].sum()) < 1:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if gain > found[0] + 1e-12:
                    found = (gain, (j, cut))
        return found[1]

    every = np.arange(len(y))
    j, cut = best(every)
    assert (m.feature[0, 0], m.cut[0, 0]) == (j, cut) and j == 0
    for node, rows in ((1, every[x[:, j] <= cut]), (2, every[x[:, j] > cut])):
        split = best(rows)
        assert (split is None and m.cut[0, node] == np.inf) or (m.feature[0, node], m.cut[0, node]) == split


def test_rows_that_repeat_an_id_are_learned_from_once(spark):
    rows = [(i % 40, f"text number {i} " * (1 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = [quality.fit(d, labels, n_trees=5) for d in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("text")))]
    assert all((m.cut == models[0].cut).all() and (m.leaf == models[0].leaf).all() for m in models)


# ---- languages


def test_presence_and_ridge():
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "αβγδεζηθ"}
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    rows = [(" ".join(word(letters[k]) for _ in range(rng.randint(1, 30))) + rng.choice(["", " 12, X!", "\n"]), k) for k in letters for _ in range(30)]
    m = langid.Model(rows, n_landmarks=20, n_grams=150)
    x = m.presence([langid.units(t) for t, _ in rows])
    plain = np.zeros(x.shape)
    for i, (t, _) in enumerate(rows):
        at = [m.index[g] for g in langid.grams(langid.letters(t)) if g in m.index]
        plain[i, at] = 1 / math.sqrt(len(at))
    assert np.allclose(x, plain, atol=1e-6)
    # the kernel, the Nyström map and the ridge regression, directly
    langs = [k for _, k in rows]
    chosen = m._landmarks(langs, 20)
    k_mm, k_nm = plain[chosen] @ plain[chosen].T, plain @ plain[chosen].T
    value, vector = np.linalg.eigh(k_mm)
    ok = value > 1e-6 * value.max()
    z = k_nm @ vector[:, ok] @ np.diag(value[ok] ** -0.5)
    y = np.array([[1.0 if k == c else -1.0 for c in m.languages] for k in langs])
    a = np.vstack([z * math.sqrt(1), np.sqrt(langid.RIDGE * len(rows)) * np.eye(z.shape[1])])
    w = np.linalg.lstsq(a, np.vstack([y - y.mean(0), np.zeros((z.shape[1], 3))]), rcond=None)[0]  # equal classes weigh one each
    margin = z @ w + y.mean(0)
    pred, score = m.predict([t for t, _ in rows])
    assert pred == [m.languages[k] for k in margin.argmax(1)]
    assert np.allclose(score, 1 / (1 + np.exp(-3 * margin.max(1))), atol=2e-3)


# ---- very long texts


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(900_000))
    notice = license_scan.TEMPLATES["mit-grant"]
    text = f"{text[:2_000_000]} token=abcdefgh1234 {notice} {text[2_000_000:]}"
    assert len(text) > 5_000_000
    rows = [(1, text), (2, "x " + text), (3, "a b c"), (4, text.replace(" ", "\n"))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_very_long_texts(spark, long, tmp_path):
    rows, df = long
    text = rows[0][1]
    n = len(text.split())
    assert {(r["doc_id"], r["kept"]) for r in exact_dedup.keepers(df).collect()} == {(1, True), (2, True), (3, True), (4, False)}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(df).collect()} == {1: 0, 2: n, 3: 0, 4: n}
    near = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert near[1]["fp"] % (1 << 64) == brute_fp(text) and near[4]["component_id"] == near[2]["component_id"] == 1
    bench = spark.createDataFrame([("b", " ".join(text.split()[500_000:500_040]))], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(df, bench).collect()} == {1: 40, 2: 40, 3: 0, 4: 40}
    ids = code(q.tokenizer(), text)
    packed = [r for r in packing.pack(df, q.tokenizer(), keep_ids=False).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in packed) == len(ids) and all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in packed)
    token_files.write_token_files(df, str(tmp_path / "t"), q.tokenizer())
    assert {r["doc_id"]: r["ids_crc32"] for r in token_files.read_digests(spark, str(tmp_path / "t")).collect()}[1] == crc(ids)
    assert {r["doc_id"] for r in license_scan.scan(df).collect()} == {1, 2, 4}
    assert {r["doc_id"]: r["n_assign"] for r in secrets_scan.digests(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    model = langid.fit(df.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in langid.predict(df, model, ["doc_id"]).collect()} == {"xx"}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score(df, quality.fit(df, labels), ["doc_id"]).count() == 4


# ---- clashing names, nulls and empty tables for the operators that test_ops gives less of


def test_awkward_rows(spark):
    cols = "doc_id long, text string, lang string, score double, predicted int, lang_pred string, held_out int, template string, base string, spans string, p double, key string, found string"
    data = [(i, t, "en" if i and i % 2 else None, 0.5, 7, "zz", 3, "t", "b", "s", 0.1, "k", "f") for i, t in ROWS]
    df = spark.createDataFrame(data, cols)
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    s = quality.score(df, quality.fit(df, labels), ["doc_id", "held_out"])
    assert s.columns == ["doc_id", "held_out", "score", "predicted"] and s.count() == len(ROWS) and {r["held_out"] for r in s.collect()} == {3}
    model = langid.fit(df)
    out = langid.predict(df, model, ["doc_id"]).collect()
    lettered = [any(map(str.isalpha, t or "")) for _, t in ROWS]
    assert sum(r["lang_pred"] == "und" for r in out) == len(ROWS) - sum(lettered) and {r["lang_pred"] for r in out} == {"und", "en"}
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == sum(lettered)
    assert quality.keep_good(df, quality.Trees(), 0.4).columns == df.columns
    assert license_scan.scan(df).count() == 0
    n = {i: brute_secrets(t)[0][0] for i, t in ROWS}
    assert all(r["n_assign"] == n[r["doc_id"]] for r in secrets_scan.digests(df).collect())
    assert SPACE.findall("a b") == ["a", "b"]
    bench = spark.createDataFrame([("x", "no such words here")], "item_id string, text string")
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len(ROWS)


# ---- language filter


def test_language_filter_follows_the_model(spark, data):
    """Foreign and mislabelled texts go, short and unlabelled ones stay, and a wrong model changes the result."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    base = docs.filter("lang is not null and length(text) between 200 and 5000").orderBy("doc_id").limit(40).collect()
    wrong = {"en": "de", "de": "fr", "fr": "es", "es": "en"}
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in base]
    rows += [(10_000 + r["doc_id"], r["text"], wrong[r["lang"]]) for r in base] + [(20_000 + r["doc_id"], r["text"], None) for r in base]
    rows += [(90001, "12 34 --", "en"), (90002, None, "en"), (90003, "", None), (90004, "Да", None), (90005, "Это совсем другой язык, которого здесь никто не знает и не учил.", None), (90006, "Re.", "en"), (90007, base[0]["text"], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_known(df, model).collect()}
    langs, scores, claims = model.judge([t for _, t, _ in rows])
    for (i, t, lang), found, score, claim in zip(rows, langs, scores, claims):
        n = sum(c.isalpha() for c in t or "")
        stay = n > 0 and not (n >= 20 and claim < 0.1) and not (lang in model.languages and lang != found and score >= 0.8)
        assert (i in kept) == stay, (i, lang, found, score)
    assert {90004, 90006, 90007} <= kept and not {90001, 90002, 90003, 90005} & kept
    assert sum(r["doc_id"] in kept for r in base) >= 39 and sum(10_000 + r["doc_id"] in kept for r in base) <= 10 and sum(20_000 + r["doc_id"] in kept for r in base) == 40
    swapped = langid.fit(docs.withColumn("lang", F.create_map(*(F.lit(x) for p in wrong.items() for x in p))[F.col("lang")]))
    assert {r["doc_id"] for r in langid.keep_known(df, swapped).collect()} != kept
    assert {r["doc_id"] for r in langid.keep_known(df, model, wanted=("de",)).collect()} < kept


# ---- simhash blocks


def test_blocks_grow_with_the_fingerprints(spark):
    assert [simhash.block_count(n) for n in (0, 50_000, 500_000, 10**7, 10**10, 10**15)] == [6, 6, 7, 8, 10, 10]
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = sorted({f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for f in base for _ in range(4)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").withColumn("table", simhash.pivot_table())

    def roots(edges):
        up = {f: f for f in fps}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for u, v in edges:
            up[max(find(u), find(v))] = min(find(u), find(v))
        return [find(f) for f in fps]

    want = roots([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 4])
    for n in (6, 7, 8, 10):
        assert roots([(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.link(df, n_blocks=n).collect()]) == want


def test_benchmark_blocks_leave_no_copies(spark, tmp_path_factory):
    """Several blocks keep digests and hits only."""
    import os

    from corpusloom.llm import common

    def shared():
        root = common.shared_dir(spark).removeprefix("file://")
        return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(root) for x in names)

    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[(i * 7 + k) % 400] for k in range(20)) + " " + f"x{i} " * 2000) for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"b{k}", " ".join(words[k * 20 : k * 20 + 15])) for k in range(20)], "item_id string, text string")
    one = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()))
    before = shared()
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench, block_bytes=500).collect())) == one
    assert shared() - before < 300_000  # the texts have over a megabyte


def test_license_blocks_and_the_size_of_the_plan(spark, monkeypatch):
    """Templates beyond one block take more passes and give the same rows; the plan of one class does not grow with them."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    templates = {f"t{k}": " ".join(rng.choice(words) for _ in range(20)) for k in range(60)}
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + " " + templates[f"t{i % 60}"] + " end") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["template"], r["window_start"]) for r in license_scan.scan(df, templates).collect())
    assert {(i, t) for i, t, _ in got} >= {(i, f"t{i % 60}") for i in range(80)}
    monkeypatch.setattr(license_scan, "MAX_TEMPLATES", 25)
    assert len(license_scan.blocks(templates)) == 3
    assert sorted((r["doc_id"], r["template"], r["window_start"]) for r in license_scan.scan(df, templates).collect()) == got
    monkeypatch.undo()
    size = lambda n: len(license_scan.scan(df, dict(list(templates.items())[:n]))._jdf.queryExecution().analyzed().toString())
    assert abs(size(3) - size(60)) < 100
