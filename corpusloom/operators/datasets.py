"""Instruction and preference sets.  Templates and keywords are parameters with fixed defaults."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Instructions and canned answers of the rule-based pairs.
EXPLAIN = "Explain the key programming concepts discussed in the content."
STEPS = ("Provide a step-by-step approach to the main topic covered.", "The content outlines a systematic approach to understanding the core concepts. It begins with fundamental principles and gradually builds up to more advanced techniques, ensuring comprehensive coverage of the subject matter.")
THEMES = ("Analyze the main themes and insights presented.", "The content explores key themes with practical insights. It provides valuable information on the subject, offering readers a deeper understanding of the concepts discussed through clear explanations and relevant examples.")
PRACTICE = ("How can the concepts be applied in practice?", "The concepts can be practically applied by following the guidelines and examples provided. The content demonstrates real-world applications that help bridge theory with practice, making the knowledge immediately useful.")
TAKEAWAYS = "Summarize the key takeaways from the content."
GENERIC = "What are the main points discussed in the content?"
ALPACA = "Below is an instruction that describes a task.\nWrite a response that appropriately completes the request.\n### Instruction:\n\n{}\n### Response:\n{}"
PREFERENCE_PROMPT = "Below is an instruction that describes a task.\nWrite a response that appropriately completes the request.\n### Instruction:\n{}\n### Response:\n"
CHAT = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n{}<|eot_id|>"
RESPONSE_MARK = "### Response:"
END = "</s>"


def fill(template: str, *values: Column) -> Column:
    """A template with {} for each value."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [T.or_empty(v), F.lit(p)]
    return F.concat(*out)


def _pair(instruction: str, output: Column) -> Column:
    return F.struct(F.lit(instruction).alias("instruction"), output.alias("output"))


def rule_pairs(extract: Column) -> Column:
    """Pairs for an extract of two long sentences or more, by what it mentions; otherwise a generic one."""
    long = F.filter(F.transform(F.split(extract, "[.!?]+", -1), T.strip), lambda s: F.char_length(s) > 20)
    low, short = F.lower(extract), T.summary(extract)
    code = F.contains(low, F.lit("python")) | F.contains(low, F.lit("code"))
    guide = F.contains(low, F.lit("tutorial")) | F.contains(low, F.lit("guide")) | F.contains(low, F.lit("how to"))
    some = F.filter(
        F.array(F.when(code, _pair(EXPLAIN, short)), F.when(guide, _pair(STEPS[0], F.lit(STEPS[1]))), _pair(THEMES[0], F.lit(THEMES[1])), _pair(PRACTICE[0], F.lit(PRACTICE[1])), _pair(TAKEAWAYS, short)),
        lambda p: p.isNotNull(),
    )
    return F.when(F.size(long) >= 2, some).otherwise(F.array(_pair(GENERIC, short)))


def generated_pairs(docs: DataFrame, extract: str, keep: list[str], provider=None) -> DataFrame:
    """Pairs from a language model (a function from texts to answers that hold the pairs' JSON), or by rule where it gives none or fails."""
    rows = docs.select(*keep, F.col(extract).alias("__e"))
    rule = rule_pairs(F.col("__e"))
    if provider is None:
        return rows.select(*keep, F.inline(rule))
    from corpusloom.session import ship
    from corpusloom.sources.readers import answer_envelope

    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(provider(t))
            except Exception:  # noqa: BLE001  whatever the provider raises
                out.append(None)
        return pd.Series(out, index=texts.index, dtype=object)

    answered = rows.withColumn("__a", ask("__e"))
    pairs = F.transform(answer_envelope(F.col("__a")), lambda p: F.struct(p["instruction"].alias("instruction"), p["answer"].alias("output")))
    return answered.select(*keep, F.inline(F.when(F.size(pairs) > 0, pairs).otherwise(rule)))


def shuffled(df: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """The rows in an order that only the seed and the keys decide."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("shuffle_key", key)


def keyword_pairs(docs: DataFrame, content: str, rules: list[tuple[str, list[str], bool, int]], constants: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """A pair for each rule (instruction, keywords, any case, length) that a text meets, and the constants once."""
    c = F.col(content)
    found = []
    for instruction, words, any_case, most in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c) if any_case else c, F.lit(w))
        found.append(F.when(hit, _pair(instruction, T.truncate(c, most))))
    pairs = docs.select(*keep, F.inline(F.filter(F.array(*found), lambda p: p.isNotNull())))
    if constants:
        fixed = docs.sparkSession.createDataFrame(constants, "instruction string, output string")
        pairs = pairs.unionByName(fixed, allowMissingColumns=True)
    return pairs


def varied_examples(docs: DataFrame, content: str, platform: str, author: str, keep: list[str]) -> DataFrame:
    """Summary, analysis and title examples (instruction, input, output) of each text."""
    c = F.col(content)
    row = lambda i, x, o: F.struct(i.alias("instruction"), x.alias("input"), o.alias("output"))
    title = T.title_guess(c)
    rows = F.array(
        F.when(F.char_length(c) > 200, row(F.concat(F.lit("Summarize the following "), F.col(platform), F.lit(" article by "), F.col(author), F.lit(":")), F.substring(c, 1, 1000), T.summary(c))),
        row(F.concat(F.lit("Analyze the key themes and topics in this "), F.col(platform), F.lit(" content:")), F.substring(c, 1, 800), T.summary(c)),
        row(F.lit("Generate an engaging title for this content:"), F.substring(c, 1, 500), F.when(title != "", title).otherwise(F.concat(F.lit("Insights from "), F.col(platform)))),
    )
    return docs.select(*keep, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def preference_triples(pairs: DataFrame, ordinal: str, alternative: str | None = None, cap: int | None = 20) -> DataFrame:
    """(instruction, chosen, rejected): even rows choose the original, odd ones the alternative; ordinals up to cap."""
    other = F.col("output") if alternative is None else F.coalesce(F.col(alternative), F.col("output"))
    rows = pairs if cap is None else pairs.filter(F.col(ordinal) <= cap)
    even = F.col(ordinal) % 2 == 0
    return rows.select(ordinal, "instruction", F.when(even, F.col("output")).otherwise(other).alias("generated_answer"), F.when(even, other).otherwise(F.col("output")).alias("extracted_answer"))


def preference_rows(triples: DataFrame, end: str = END) -> DataFrame:
    return triples.select(fill(PREFERENCE_PROMPT, F.col("instruction")).alias("prompt"), F.concat("generated_answer", F.lit(end)).alias("chosen"), F.concat("extracted_answer", F.lit(end)).alias("rejected"))


def alpaca_text(instruction: Column, output: Column, end: str = END) -> Column:
    return F.concat(fill(ALPACA, instruction, output), F.lit(end))


def chat_text(system: Column, prompt: Column, response: Column) -> Column:
    return fill(CHAT, system, prompt, response)


def split(df: DataFrame, key: str, share: float, seed: str = "42") -> DataFrame:
    """Adds split: test for about `share` of the keys by their hash, otherwise train; needs no order of the whole."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(h < F.lit(int(share * (1 << 32))), "test").otherwise("train"))


def answered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, output): each user or system turn with the assistant's at the turn after it.

    A join on conversation and turn, so that a very long conversation is spread like short ones.
    """
    asked = turns.filter(F.col("role").isin("user", "system")).select("conv_id", "turn", F.col("text").alias("instruction"))
    given = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(given, ["conv_id", "turn"])


def with_alternatives(pairs: DataFrame, apart: int = 2) -> DataFrame:
    """Adds other: the output of the pair `apart` turns later in the same conversation, null at its end."""
    later = pairs.select("conv_id", (F.col("turn") - apart).alias("turn"), F.col("output").alias("other"))
    return pairs.join(later, ["conv_id", "turn"], "left")
