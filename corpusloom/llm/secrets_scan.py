"""Secret scan: fixed patterns, and a randomness test battery for other tokens.

All of it is DataFrame functions.  A text is matched where it lies; positions
follow from the pieces between matches, as the SQL functions return no
offsets.

Battery: a token is a run of 20 or more base64 characters; shorter ones are
never judged, as no test says anything of them.  Its encoding is inferred
(decimal, hex, letters of one case, base32, base36, letters, base64) and three
tests take it as uniform over that alphabet: chi-squared of the character
counts, runs above and below the middle of the alphabet, and lag-1 serial
correlation.  The token's p is 1 - (1 - smallest)**3, which for a random token
is about uniform.  Tokens of text have p near 0; how many of them lie above a
cut is known for each encoding and length class from generated ones, so that a
single key is judged like one of thousands.  The smallest cut is taken at
which the expected share of text among the reported tokens is at most `fdr`;
where a class has many random tokens, its own counts tell that share.  Short
tokens and small alphabets, whose tests are weak, thus need a higher cut, and
a class in which no cut keeps the bound is not reported.  The counts are a few
rows; the tokens stay with their documents.

Defined results: null texts are empty and have no spans; battery spans never
overlap pattern spans; repeated documents are judged each by itself; columns
but doc_id and text are ignored; an empty table gives no rows.  A text of any
length is scanned whole, in proportion to its length and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Fixed values of the contract: kind, pattern, the group that is measured, its least length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the maximal runs of [0-9a-f]+ that are long enough
)
RANDOM = "random"
#: Matches whose spans are built together.
_BLOCK = 128
_RUN = "[A-Za-z0-9+/_-]"
_TOKEN = rf"(?<!{_RUN}){_RUN}{{20,}}"
_SPAN = "array<struct<start:int,k:int,end:int,n:int,t:string>>"
_ALPHABET = {10: "0123456789", 16: "0123456789abcdef", 26: "abcdefghijklmnopqrstuvwxyz", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 52: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
FDR = 0.05
_CUTS = (0.01, 0.03, 0.1, 0.2, 0.4)
#: By alphabet, the share of text tokens whose p is above each of _CUTS, a row for each of _LENGTHS.
#: Measured on 3,000 tokens each (English words joined as slugs, capitals, upper case or with numbers; of digits, dates and round numbers); test_text_tokens measures them anew.
_TEXT_ABOVE = {
    10: ((0.3687, 0.099, 0.0397, 0.0093, 0.001), (0.111, 0.0543, 0.017, 0.003, 0.001), (0.0203, 0.0037, 0.0003, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)),
    16: ((0.0043, 0.0013, 0.0003, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)),
    26: ((0.914, 0.8503, 0.689, 0.5427, 0.3197), (0.844, 0.7387, 0.54, 0.381, 0.1977), (0.5893, 0.428, 0.2333, 0.126, 0.0477), (0.249, 0.1423, 0.051, 0.0187, 0.0047), (0.0313, 0.0113, 0.0027, 0.0007, 0.0)),
    32: ((0.788, 0.6917, 0.462, 0.3353, 0.1593), (0.6187, 0.471, 0.2667, 0.176, 0.0633), (0.2513, 0.1407, 0.0513, 0.0207, 0.0067), (0.0207, 0.005, 0.0003, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)),
    36: ((0.8543, 0.794, 0.6157, 0.4843, 0.2787), (0.7627, 0.6733, 0.48, 0.328, 0.1823), (0.5097, 0.3677, 0.2233, 0.125, 0.0513), (0.201, 0.1183, 0.0517, 0.0257, 0.0073), (0.0253, 0.01, 0.003, 0.0007, 0.0)),
    52: ((0.728, 0.6393, 0.4633, 0.305, 0.152), (0.5563, 0.4207, 0.2413, 0.138, 0.043), (0.2093, 0.1183, 0.0437, 0.0163, 0.002), (0.0183, 0.007, 0.001, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)),
    64: ((0.4253, 0.3307, 0.164, 0.096, 0.0293), (0.1967, 0.1083, 0.0407, 0.021, 0.0023), (0.028, 0.0097, 0.003, 0.001, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)),
}
#: A share of zero above means less than this.
_LEAST_SHARE = 0.0003
#: With so many tokens above _SURE the table itself tells how many are random.
_MANY = 20
#: The p-values above are taken for random tokens' alone; no cut lies there.
_SURE = 0.5
#: Length classes start here.
_LENGTHS = (20, 24, 32, 48, 64)


def _matches(text: Column, pattern: str, group: int, least: int, k: int) -> Column:
    """The spans of leftmost non-overlapping matches whose group is long enough.

    Offsets are sums of the lengths before; they are summed by blocks, so that
    the work is in proportion to the matches, however many a text has.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.transform(
        F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("p"), whole.alias("m"), value.alias("v")),
        lambda s: F.struct(F.char_length(s["p"]).alias("gap"), F.char_length(s["m"]).alias("n"), s["v"].alias("v")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<int>")

    def before(totals: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(totals, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(k).alias("k"), (start + s["n"]).alias("end"), F.char_length(s["v"]).alias("n"), s["v"].alias("t"))
        return F.struct((start + s["n"]).alias("at"), F.concat(acc["out"], F.array(span).cast(_SPAN)).alias("out"))

    def spans(bs: Column) -> Column:
        at = before(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["gap"] + s["n"])))
        each = F.zip_with(bs, at, lambda b, a: F.aggregate(b, F.struct(a.alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"])
        return F.filter(F.flatten(each), lambda s: s["n"] >= least)

    found = F.element_at(F.transform(F.array(blocks), spans), 1)  # binds the blocks, so that they are made once
    # most texts have none: one search decides
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic form (error below 2e-4)."""
    x = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * x + F.lit(0.070565992) * x * x * x))


def _battery(size: Column, codes: Column) -> Column:
    """p of the three tests for one token; codes are its characters' places in the alphabet of `size`."""
    n = F.size(codes).cast("double")
    a = size.cast("double")
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0)))
    df = a - 1
    chi = squares * a / n - n
    third = F.lit(2.0) / (F.lit(9.0) * df)
    p_chi = _tail((F.cbrt(F.greatest(chi / df, F.lit(1e-9))) - (F.lit(1.0) - third)) / F.sqrt(third))
    high = F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.when(c * 2 >= size, 1.0).otherwise(0.0))
    low = n - high
    pairs = F.sequence(F.lit(2), F.size(codes))
    runs = F.lit(1.0) + F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.when((F.element_at(codes, i) * 2 >= size) != (F.element_at(codes, i - 1) * 2 >= size), 1.0).otherwise(0.0))
    mu = F.lit(2.0) * high * low / n + 1
    var = F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9))
    p_runs = F.lit(2.0) * _tail(F.abs(runs - mu) / F.sqrt(var))
    mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
    spread = F.greatest(F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean)), F.lit(1e-9))
    lag = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + (F.element_at(codes, i) - mean) * (F.element_at(codes, i - 1) - mean))
    p_serial = F.lit(2.0) * _tail(F.abs(lag / spread) * F.sqrt(n))
    return F.when((high == 0) | (low == 0), F.lit(0.0)).otherwise(F.lit(1.0) - F.pow(F.lit(1.0) - F.least(F.lit(1.0), p_chi, p_runs, p_serial), F.lit(3.0)))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(_LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, base, extra): arrays of spans (start, k, end), one row a document.

    base has the fixed patterns' spans in order, extra those of the battery.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    found = found.select("doc_id", F.array_sort(F.concat(*(_matches(F.col("text"), p, g, n, k) for k, (_, p, g, n) in enumerate(KINDS)))).alias("base"), _matches(F.col("text"), _TOKEN, 0, 20, len(KINDS)).alias("tokens"))
    tokens = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def size(t: Column) -> Column:
        one_case = lambda letters, n, out: out.when(t.rlike(f"^([{letters}]+|[{letters.upper()}]+)$"), n)
        return one_case("0-9a-z", 36, one_case("a-z", 26, one_case("0-9a-f", 16, F.when(t.rlike("^[0-9]+$"), 10))).when(t.rlike("^[A-Z2-7]+$"), 32)).when(t.rlike("^[A-Za-z]+$"), 52).otherwise(64)

    sized = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), size(s["t"]).alias("size"), s["t"].alias("t")))

    def code(t: Column, a: Column) -> Column:
        letters = F.split(F.when(a.isin(16, 26, 36), F.lower(t)).otherwise(F.translate(t, "-_", "+/")), "")
        alphabet = F.lit("")
        for n, x in _ALPHABET.items():
            alphabet = F.when(a == n, x).otherwise(alphabet)
        return F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)

    coded = F.transform(sized, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["size"].alias("size"), code(s["t"], s["size"]).alias("codes")))
    judged = F.transform("coded", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["size"] * 10 + _length_class(s["end"] - s["start"])).alias("class"), _battery(s["size"], s["codes"]).alias("p")))
    light = found.select("doc_id", "base", tokens.alias("tokens")).select("doc_id", "base", coded.alias("coded"))
    light = light.select("doc_id", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))).alias("base"), judged.alias("tokens"))
    light = common.written(light, "secret-tokens")  # spans and p-values, no text
    cut = _cuts(light, fdr)
    extra = F.filter("tokens", lambda s: _above(s, cut))
    return light.select("doc_id", "base", F.transform(extra, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("k"), s["end"].alias("end"))).alias("extra"))


def _above(s: Column, cut: dict[int, float]) -> Column:
    out = F.lit(False)
    for c, t in sorted(cut.items()):
        out = F.when(s["class"] == c, s["p"] > t).otherwise(out)
    return out


def cut_of(size: int, length: int, n: int, sure: int, above: list[int], fdr: float = FDR) -> float | None:
    """The cut of one class, or None where none keeps the bound.

    n tokens, of which `sure` have p above _SURE and `above` are above each of
    _CUTS.  Of the text tokens among them a share that is known from elsewhere
    lies above a cut (_TEXT_ABOVE), however few tokens there are; with many
    random ones, the excess over what those explain counts instead.
    """
    random = sure / (1 - _SURE)
    text = max(1.0, n - random)
    for c, count, share in zip(_CUTS, above, _TEXT_ABOVE[size][length]):
        wrong = count - random * (1 - c) if sure >= _MANY else text * max(share, _LEAST_SHARE)
        if count and wrong <= fdr * count:
            return c
    return None


def _cuts(light: DataFrame, fdr: float) -> dict[int, float]:
    """The cut of each encoding and length class that has one; at most len(_ALPHABET) * len(_LENGTHS) entries."""
    token = light.select(F.explode("tokens").alias("s")).select("s.class", "s.p")
    counts = token.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") > _SURE).alias("sure"), *(F.count_if(F.col("p") > c).alias(f"n{i}") for i, c in enumerate(_CUTS))).collect()
    found = {r["class"]: cut_of(r["class"] // 10, r["class"] % 10, r["n"], r["sure"], [r[f"n{i}"] for i in range(len(_CUTS))], fdr) for r in counts}
    return {k: c for k, c in found.items() if c is not None}


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["k"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return scan(docs, fdr).select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
