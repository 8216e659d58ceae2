"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (all lengths of
NGRAMS) present in both, divided by the root of the product of the numbers
present in each.  Nyström landmarks, drawn from the training rows, map a text
to K(text, landmarks) K(landmarks, landmarks)^-1/2, and one-versus-rest
kernel ridge regression on this map gives a score for each language.  Scoring
a batch is two matrix products: presence matrix by landmarks, then by
weights.

Grams are taken within the words of the whole lower-cased text, a space at
either end of a word; what is no letter separates words.  Training uses at most `max_train` labelled rows
for the regression and, of these, `n_landmarks` landmarks; both are the rows with the
smallest hashes, evenly from each language, so the sample does not depend on
partitions; every language has a row and a landmark at least.  Rows longer
than `max_chars` are predicted whole; they are learned from, by their first
`max_chars` characters without runs of other than letters, only where a
language has no shorter ones.  The dictionary holds `n_grams` grams: the
languages choose in turn, each its most widespread gram that is not chosen
yet, so none goes without its letters; OWN_GRAMS of its own at least, however
many languages there are.

Defined results: null texts and texts without a letter are `und` with score
0; rows with a null language or without a letter are not learned from; with no row to learn from
everything is `und`.  Ties between languages go to the first by name.
Repeated rows are rows of their own.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

UNKNOWN = "und"
#: keep_known: texts of so many letters are refused if their claim is below LEAST; another language than stated is believed from SURE on.
JUDGED = 20
LEAST = 0.1
SURE = 0.8
NGRAMS = (1, 2, 3)
MAX_TRAIN = 1600
MAX_CHARS = 20_000
N_LANDMARKS = 256
N_GRAMS = 6000
RIDGE = 1e-3
#: Grams that a language chooses at least, though the dictionary then outgrows `n_grams`.
OWN_GRAMS = 16
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters, one space for what stands between; empty without a letter."""
    s = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {s} " if any(map(str.isalpha, s)) else ""


def grams(text: str, sizes: tuple[int, ...] = NGRAMS) -> set[str]:
    """The distinct n-grams of a text, found through its distinct words."""
    out: set[str] = set()
    for w in set(text.split()):
        w = f" {w} "
        for n in sizes:
            out.update([w[i : i + n] for i in range(len(w) - n + 1)])
    return out


#: Slots of a level of the gram tables, as a power of two.
_SLOTS = 17


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


class _Tables:
    """The dictionary as arrays: character -> letter code, and hashed codes of n letters -> gram, so a text takes a few array operations."""

    def __init__(self, index: dict[str, int], sizes: tuple[int, ...]):
        chars = sorted({c for g in index for c in g} | {" "})
        self.none, self.base, self.sizes = len(index), len(chars) + 1, sizes
        other, self.letter = _classes()
        place = {c: i + 1 for i, c in enumerate(chars)}
        self.code = np.where(other, place[" "], 0)  # what is no letter separates words
        for c, i in place.items():
            self.code[ord(c)] = i
        self.gram = {n: self._levels([(g, i) for g, i in index.items() if len(g) == n], place) for n in sizes}

    def _levels(self, grams: list[tuple[str, int]], place: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and grams by slot; of grams that meet in a slot one stays in each level."""
        keys, at = np.zeros(len(grams), np.int64), np.array([i for _, i in grams], np.int64)
        for r, (g, _) in enumerate(grams):
            for c in g:
                keys[r] = keys[r] * self.base + place[c]
        out = []
        while keys.size:
            slots, first = np.unique(_slot(keys), return_index=True)
            key, gram = np.full(1 << _SLOTS, -1, np.int64), np.full(1 << _SLOTS, self.none, np.int32)
            key[slots], gram[slots] = keys[first], at[first]
            out.append((key, gram))
            keys, at = np.delete(keys, first), np.delete(at, first)
        return out

    def mark(self, row: np.ndarray, units: np.ndarray) -> None:
        a = self.code[units]
        k = a
        for n in range(1, max(self.sizes) + 1):
            if n > 1:
                k = k[:-1] * self.base + a[n - 1 :]
            if self.gram.get(n):
                slots = _slot(k)
                for key, gram in self.gram[n]:
                    row[gram[slots[key[slots] == k]]] = 1


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of every character, whether it separates words and whether it is a letter."""
    chars = "".join(map(chr, range(sys.maxunicode + 1)))
    other = np.zeros(len(chars), bool)
    for m in _OTHER.finditer(chars):
        other[m.start() : m.end()] = True
    return other, np.fromiter(map(str.isalpha, chars), bool, len(chars))


def units(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """Dictionary, landmark matrix and weights."""

    def __init__(self, labelled: list[tuple[str, str]], n_landmarks: int = N_LANDMARKS, n_grams: int = N_GRAMS, ridge: float = RIDGE, sizes: tuple[int, ...] = NGRAMS):
        rows = [(s, lang) for t, lang in labelled if (s := letters(t))]
        self.sizes = sizes
        self.languages = sorted({lang for _, lang in rows})
        if max(sizes) > 3:
            raise ValueError("grams of at most 3 letters")
        if not rows:
            return
        self.index = self._dictionary(rows, n_grams)
        x = self.presence([units(s) for s, _ in rows])
        chosen = self._landmarks([lang for _, lang in rows], max(n_landmarks, len(self.languages)))
        self.landmarks = np.ascontiguousarray(x[chosen].T)
        inner = self.landmarks.T @ self.landmarks
        value, vector = np.linalg.eigh(inner.astype(np.float64))
        ok = value > 1e-6 * value.max()
        root = vector[:, ok] / np.sqrt(value[ok])
        z = (x @ self.landmarks) @ root
        y = np.array([[1.0 if lang == c else -1.0 for c in self.languages] for _, lang in rows])
        self.middle = y.mean(axis=0)
        # a language with few rows counts as much as one with many
        weight = np.array([1.0 / n for n in map(Counter(lang for _, lang in rows).__getitem__, (lang for _, lang in rows))])[:, None] * len(rows) / len(self.languages)
        a = z.T @ (weight * z) + ridge * len(rows) * np.eye(z.shape[1])
        self.weights = (root @ np.linalg.solve(a, z.T @ (weight * (y - self.middle)))).astype(np.float32)

    def _dictionary(self, rows: list[tuple[str, str]], n: int) -> dict[str, int]:
        """n grams, chosen by the languages in turn, each its most widespread one that is left; OWN_GRAMS turns at least."""
        spread: dict[str, Counter[str]] = {c: Counter() for c in self.languages}
        for s, lang in rows:
            spread[lang].update(grams(s, self.sizes))
        left = {c: iter(sorted(spread[c], key=lambda g, x=spread[c]: (-x[g], g))) for c in self.languages}
        out: dict[str, int] = {}
        turn = 0
        while left and (turn < OWN_GRAMS or len(out) < n):
            for c in list(left):
                if turn >= OWN_GRAMS and len(out) >= n:
                    break
                g = next((g for g in left[c] if g not in out), None)
                if g is None:
                    del left[c]
                else:
                    out[g] = len(out)
            turn += 1
        return out

    @staticmethod
    def _landmarks(langs: list[str], n: int) -> list[int]:
        """The first rows of each language in turn."""
        turn: Counter[str] = Counter()
        place = []
        for i, lang in enumerate(langs):
            place.append((turn[lang], i))
            turn[lang] += 1
        return sorted(i for _, i in sorted(place)[:n])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row for each text's units, of unit length: 1 / root of the number of grams present, where present."""
        if "tables" not in self.__dict__:
            self.tables = _Tables(self.index, self.sizes)
        x = np.zeros((len(texts), len(self.index) + 1), np.float32)
        for row, u in zip(x, texts):
            self.tables.mark(row, u)
        x = x[:, :-1]
        n = x.sum(axis=1, keepdims=True)
        return np.divide(x, np.sqrt(n), out=np.zeros_like(x), where=n > 0)

    def known(self, text: str | None) -> np.ndarray | None:
        """The units of a text with a letter."""
        if not text:
            return None
        u = units(text)
        return u if self.tables.letter[u].any() or any(map(str.isalpha, text)) else None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; a score is the sigmoid of the best margin."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The same, and how far the text's own grams lift the best language above what it has without any."""
        langs, scores, claims = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores, claims
        if "tables" not in self.__dict__:
            self.tables = _Tables(self.index, self.sizes)
        for a in range(0, len(texts), 256):
            some = [(i, u) for i, t in enumerate(texts[a : a + 256], a) if (u := self.known(t)) is not None]
            if not some:
                continue
            own = (self.presence([u for _, u in some]) @ self.landmarks) @ self.weights
            f = own + self.middle
            for (i, _), k, m, c in zip(some, f.argmax(axis=1).tolist(), f.max(axis=1).tolist(), own.max(axis=1).tolist()):
                langs[i], scores[i], claims[i] = self.languages[k], 1.0 / (1.0 + float(np.exp(-3.0 * m))), c
        return langs, scores, claims


def fit(docs: DataFrame, usable: Column | None = None, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS, id_col: str = "doc_id", **options) -> Model:
    """Learns from text and lang of usable rows: about max_train of them, each of max_chars characters at most; one at least of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (usable if usable is not None else F.lit(True)))
    rows = rows.select(F.col(id_col).alias("id"), "text", "lang", (F.char_length("text") > max_chars).alias("long"))
    order = F.xxhash64("id", F.lit(5))
    found = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count(F.lit(1)).alias("all")).collect()  # a row for each language
    counts = {r["lang"]: r["short"] or r["all"] for r in found}
    if not counts:
        return Model([], **options)
    each = max(1, max_train // len(counts))
    # rows with small hashes, about four times as many as needed, so that the ranking sees a bounded number
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": [r["lang"] for r in found], "share": [min(1.0, (4.0 * each + 50) / counts[r["lang"]]) for r in found], "only_long": [not r["short"] for r in found]}))
    some = rows.join(F.broadcast(shares), "lang").filter(~F.col("long") | F.col("only_long")).filter(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    some = some.withColumn("text", F.when(F.col("long"), F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, max_chars)).otherwise(F.col("text")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 30)), "id", "text"))
    sample = some.withColumn("__n", place).filter(F.col("__n") <= each).orderBy("__n", "lang").select("text", "lang").collect()
    return Model([(r["text"], r["lang"]) for r in sample], **options)


def predicted(spark: SparkSession, model: Model):
    """A column function of texts: struct of lang_pred, score and claim.  Nothing else of a row goes to Python."""
    shared = common.prepare(spark).sparkContext.broadcast(model)  # bounded by n_grams times n_landmarks

    @F.arrow_udf("lang_pred string, score double, claim double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores, claims = shared.value.judge(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(claims, pa.float64())], ["lang_pred", "score", "claim"])
        common.release()

    return run.asNondeterministic()  # so that it runs once, however often its fields are used


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of keep, lang_pred and score."""
    run = predicted(docs.sparkSession, model)
    return common.boxed(docs).withColumn("__p", run(common.field("text"))).select(*common.fields(keep), "__p.lang_pred", "__p.score")


def keep_known(docs: DataFrame, model: Model, lang_col: str = "lang", wanted: tuple[str, ...] | None = None, least: float = LEAST, sure: float = SURE, letters: int = JUDGED) -> DataFrame:
    """The rows whose language is recognised, with their columns.

    A row goes if its text has no letter; if it has at least `letters` letters
    and no language claims it (the best claim is below `least`); if it states
    a language that was learned and the model is sure of another (score at
    least `sure`); or if its language is none of `wanted`.  Shorter texts say
    too little to be refused for their score.  Where nothing was learned, rows
    with a letter stay, though predict() calls them `und`.
    """
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    run = predicted(docs.sparkSession, model)
    rows = common.boxed(docs).withColumn("__p", run(common.field("text")))
    lang, score = F.col("__p.lang_pred"), F.col("__p.score")
    own = common.field(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    foreign = (F.col("__p.claim") < least) & (F.char_length(F.regexp_replace(common.field("text"), r"[^\p{L}]", "")) >= letters)
    other = F.coalesce(own.isin(model.languages) & (own != lang), F.lit(False)) & (score >= sure)
    stay = (lang != UNKNOWN) & ~foreign & ~other
    if wanted is not None:
        stay = stay & lang.isin(list(wanted))
    return common.unboxed(rows.filter(stay).select(common.ROW))
