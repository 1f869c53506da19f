"""Quality rules: a threshold table compiled into Spark projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as in `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the languages that the rules serve.
STOP_WORDS = (
    "a and are as at be by for from has have in is it not of on or that the this to was were which with "  # en
    "au avec ce dans de des du elle en est et il la le les mais ou par pas pour que qui sur un une "  # fr
    "auf aus das dem den der des die ein eine er für ist mit nicht sich sie und von zu "  # de
    "al como con del el en es la las lo los no para por que se su un una y"  # es
).split()
#: As they stand in texts; lower-casing every word would cost more than all other measures.
CASED = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` (SQL over the measures' names) is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are over words or over lines that have a word.
RULES = (
    Rule("longest", "n_words", high=1_000_000),
    Rule("word_length", "word_chars / n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols / n_words", high=0.5),
    Rule("exclamations", "n_exclaims / n_words", high=0.5),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines / n_lines", high=0.9),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where every rule holds; a measure that is null (no words, no lines) fails none."""
    holds = F.lit(True)
    for rule in rules:
        value = F.expr(rule.measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
        if rule.low is not None:
            holds = holds & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            holds = holds & F.coalesce(value <= rule.high, F.lit(True))
    return holds


def _stripped_count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _windows(words: str) -> Column:
    """A hash of each run of WINDOW words, from the array of word hashes."""
    hashed = F.transform(F.col(words), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, WINDOW)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the measures that rules may use. A chain of projections, no exchange.

    Null text has no words, lines or symbols: every count is 0. Other columns are not read. Windows of words are
    compared by 64-bit hashes of their words' hashes, within one text.
    """
    step = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(SPACES))
    step = step.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
        _stripped_count(F.col("t"), SYMBOLS + "+").alias("n_symbols"),
        _stripped_count(F.col("t"), "!+").alias("n_exclaims"),
    )
    step = step.select(
        "doc_id",
        "n_symbols",
        "n_exclaims",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size(F.filter("w", lambda w: w.isin(*CASED))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))).alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda line: F.substring(F.ltrim(line), 1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept = [c for c in step.columns if c != "h"]
    step = step.select(*kept, _windows("h").alias("win"))
    # Most texts repeat no window; only those that do are sorted.
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    step = step.select(*kept, F.when(repeats, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    twin = lambda e, i: (e["h"] == F.get(F.col("s"), i - 1)["h"]) | (e["h"] == F.get(F.col("s"), i + 1)["h"])
    marked = F.transform("s", lambda e, i: F.when(twin(e, i), e["i"]))
    step = step.select(*kept, F.sort_array(F.filter(marked, lambda i: i.isNotNull())).alias("p"))
    covered = F.transform("p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - i, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    measured = step.select(*kept, F.coalesce(total, F.lit(0)).alias("n_repeat_words"))
    # One struct a row, unpacked: what is filtered or joined on above isn't pushed through the projections, where the
    # arrays would be computed anew for each of their elements.
    names = measured.columns[1:]
    return measured.select("doc_id", F.inline(F.array(F.struct(*names))))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the counts as longs, base_failed and kept (the table's verdict).

    The base fails under 20 words, or where more than 30 % of the words stand in a run of WINDOW words that the
    text has twice or more. Empty and null texts fail; an empty table gives an empty result; repeated rows are
    judged alike.
    """
    m = measures(docs, id_col=id_col, text=text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words").cast("long") > 30 * F.col("n_words").cast("long"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = ["n_lines", "n_stop_words", "n_exclaims", "n_ellipsis_lines", "n_bullet_lines"]
    return m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts], failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), *[F.col(c).cast("long").alias(c) for c in extra])
