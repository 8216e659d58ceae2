"""Text rules as Column expressions; no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters and white space as Python's `re` has them, for Java's regex.
WORD = r"\p{L}\p{N}_"
#: The most frequent characters first, as a class is tried in order.
_KEEP = rf"a-zA-Z {WORD}"
SPACE = r"\s\x1c-\x1f"  # under (?U), where \s is all white space of Unicode
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A sentence ends at white space after . ? or !, except after abbreviations such as "e.g." and "Dr.";
#: the white space comes first in the pattern, so that other characters fail at once.
SENTENCE_END = rf"(?U)[{SPACE}](?<=[.?!][{SPACE}])(?<![{WORD}]\.[{WORD}].[{SPACE}])(?<![A-Z][a-z]\.[{SPACE}])"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def single_spaces(c: Column) -> Column:
    """Each run of white space as one space; single spaces, most of them, are not even matched."""
    return F.regexp_replace(c, rf"(?U)[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " ")


def collapse(c: Column) -> Column:
    """White space runs as one space each, none at the ends."""
    return F.trim(single_spaces(c))


def iso(at: Column) -> Column:
    """A time as YYYY-MM-DDTHH:MM:SS; which time is the caller's, as in tests."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: What web noise removal takes out, in order.
WEB_NOISE = (r"https?://[!$-_a-z]+", r"<[^>]+>", r"\[edit\]", r"\{\{[^}]*\}\}", r"&[a-zA-Z]+;")


def clean_web(c: Column) -> Column:
    """URLs, tags, wiki marks and entities go; then characters other than words and simple marks."""
    c = or_empty(c)
    for pattern in WEB_NOISE:
        c = F.regexp_replace(c, pattern, " ")
    return strip(F.regexp_replace(collapse(c), rf"(?U)[^{_KEEP}{SPACE}.!?,;:\-'\"]+", ""))


def clean_typed(c: Column) -> Column:
    """Spacing first, then characters other than words, marks and brackets."""
    return strip(F.regexp_replace(single_spaces(or_empty(c.cast("string"))), rf"(?U)[^{_KEEP}{SPACE}.,!?;:\-()\[\]{{}}\"'/\\]+", ""))


def clean_prose(c: Column) -> Column:
    """Characters other than words and . , ! ? ' become spaces, then spacing."""
    return collapse(F.regexp_replace(or_empty(c), rf"(?U)[^{_KEEP}{SPACE}.,!?']", " "))


def sentences(c: Column) -> Column:
    """The sentences of a text, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE_END, -1), strip), lambda s: s != "")


def truncate(c: Column, n: int, always: bool = False) -> Column:
    """The first n characters and an ellipsis where (or whether or not) more follow."""
    cut = F.concat(F.substring(c, 1, n), F.lit("..."))
    return cut if always else F.when(F.char_length(c) > n, cut).otherwise(c)


def summary(c: Column, n: int = 3) -> Column:
    """The first n non-blank spans between runs of . ! ?, as sentences."""
    spans = F.filter(F.transform(F.split(c, "[.!?]+", -1), strip), lambda s: s != "")
    return F.concat(F.array_join(F.slice(spans, 1, n), ". "), F.lit("."))


def title_guess(c: Column) -> Column:
    """Of the first five lines, the first that is not blank, long or a heading; else empty."""
    lines = F.transform(F.slice(F.split(c, "\n", -1), 1, 5), strip)
    good = F.filter(lines, lambda s: (s != "") & (F.char_length(s) < 100) & ~s.startswith("#"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def first_name(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(strip(c), rf"(?U)[{SPACE}]+"), lambda s: s != ""), F.lit(1)), F.lit(""))


def last_name(c: Column) -> Column:
    """All but the first token."""
    tokens = F.filter(F.split(strip(c), rf"(?U)[{SPACE}]+"), lambda s: s != "")
    return F.array_join(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), " ")


def json_in_text(c: Column) -> Column:
    """From the first { to the last }; null without them."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def after(c: Column, marker: str) -> Column:
    """What follows the first marker, stripped; the whole text without one."""
    return F.when(F.contains(c, F.lit(marker)), strip(F.split_part(c, F.lit(marker), F.lit(2)))).otherwise(c)


def listing(name: str, items: Column) -> Column:
    """`Name: a, b`."""
    return F.concat(F.lit(name.title() + ": "), F.array_join(items, ", "))
