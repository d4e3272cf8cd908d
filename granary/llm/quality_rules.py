"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 3-word windows and reject short or
repetitive texts. Five further rules reject a text whose score is above a cutoff. Cutoffs are
chosen per stratum (language) on labelled documents: a cutoff may be used only if, for good
documents (quality 1), the hypothesis "its false rejection rate exceeds RISK / rules" is refuted
by the exact binomial tail P(Bin(n, RISK / rules) <= rejected) at level DELTA / (strata * rules).
Cutoffs go from lenient to strict and the first that is not refuted ends the sequence, so within
a rule no further correction is needed; over strata and rules it is Bonferroni's. With
probability 1 - DELTA no stratum loses more than RISK of its good documents to these rules. A
stratum with too few labels gets no cutoff and loses none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm._store import written

WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED = 50, 50
RISK, DELTA = 0.05, 0.05

#: Cutoffs of each rule, lenient to strict. Fixed beforehand: they are never fitted.
CUTOFFS: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04],
    "repeat_share": [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "exclaim_share": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
}

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MADE = [*_BASE, "base_failed", *CUTOFFS]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are hashed and sorted with
    their places, so equal ones are neighbours; the places they cover are counted once."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce((k > 0) & (F.get(s, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.sort_array(hashed), covered)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with the base counts, base_failed and the rules' scores; a null text counts as
    empty. Columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    split = docs.drop(*_MADE).withColumn("__words", F.array_remove(F.split(text, WHITE), ""))

    def lines(split: Column) -> Column:
        return _let(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda own: F.struct(F.size(own).alias("all"), F.size(F.array_distinct(own)).alias("distinct")))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), F.char_length(F.array_join(words, "")).cast("long").alias("chars"), _repeated(words).alias("repeated"))

    out = split.withColumns({"__c": _let(F.col("__words"), counts), "__l": lines(F.split(text, "\n"))}).withColumns(
        {
            "n_words": F.col("__c.n"),
            "word_chars": F.col("__c.chars"),
            "n_symbols": without(r"[#*$%&|<>]").cast("long"),
            "n_dup_lines": (F.col("__l.all") - F.col("__l.distinct")).cast("long"),
            "n_repeat_words": F.col("__c.repeated"),
            "__upper": without(r"\p{Lu}"),
            "__exclaim": F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit(""))),
        }
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, chars = F.col("n_words"), F.col("word_chars")
    return out.withColumns(
        {
            "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n),
            "symbol_share": share(F.col("n_symbols"), chars),
            "repeat_share": share(F.col("n_repeat_words"), n),
            "dup_line_share": share(F.col("n_dup_lines"), F.col("__l.all")),
            "upper_share": share(F.col("__upper"), chars),
            "exclaim_share": share(F.col("__exclaim"), n),
        }
    ).drop("__words", "__c", "__l", "__upper", "__exclaim")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact: terms are summed as logarithms. From k = n * p on it is given
    as 1, which no test at a level under one half needs more exactly."""
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        def added(term: Column) -> Column:
            top = F.greatest(term, acc["sum"])
            return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["sum"] - top))).alias("sum"))

        return _let(acc["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p))), added)

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, step, lambda acc: acc["sum"])))


def thresholds(scored: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule: its cutoff or null). Labels are joined by doc_id; a
    document with several labels is good if all are. Documents without the base rules' consent
    are left out, for these rules never see them."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")
    held = scored.where(~F.col("base_failed")).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *CUTOFFS).join(good, "doc_id")
    counts = [F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}_{i}") for rule, cuts in CUTOFFS.items() for i, c in enumerate(cuts)]
    per = written(held.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "risk-counts")
    cells = F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, cuts in CUTOFFS.items() for i, c in enumerate(cuts))))
    tests = F.lit(len(CUTOFFS) * max(1, per.count()))
    tail = binomial_tail(F.col("n"), F.col("k"), risk / len(CUTOFFS))
    tested = per.withColumn("level", F.lit(delta) / tests).select("stratum", "n", "level", cells).withColumn("valid", tail <= F.col("level"))
    so_far = F.min(F.col("valid").cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("i"))
    allowed = tested.withColumn("valid", so_far == 1)
    return written(allowed.groupBy("stratum").agg(*(F.min(F.when((F.col("rule") == rule) & F.col("valid"), F.col("cutoff"))).alias(rule) for rule in CUTOFFS)), "risk-cutoffs")


def judged(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds `kept` to measured rows."""
    renamed = cutoffs.select(F.col("stratum").alias("__stratum"), *(F.col(rule).alias(f"__{rule}") for rule in CUTOFFS))
    over = F.lit(False)
    for rule in CUTOFFS:
        over = over | F.coalesce(F.col(rule) > F.col(f"__{rule}"), F.lit(False))
    joined = scored.drop("kept").join(renamed, F.coalesce(F.col(stratum), F.lit("")) == F.col("__stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("__stratum", *(f"__{rule}" for rule in CUTOFFS))


def assess(docs: DataFrame, labels: DataFrame, keep_text: bool = False) -> DataFrame:
    """`docs` with counts, scores and kept, without text unless it is asked for. Measured rows
    are written once: the labelled ones set the cutoffs and all are judged from there.

    A null text counts as empty; both fail the base rules. Very long texts are measured whole. A
    null stratum is a stratum of its own (''). Rows with a null doc_id have no label; rows that
    repeat a doc_id are each judged by their own text and share its labels. A score equal to a
    cutoff is kept. Columns named as the counts, scores, base_failed and kept are replaced. An
    empty table gives an empty result, and without labels only the base rules reject."""
    scored = written(measured(docs) if keep_text else measured(docs).drop("text"), "quality")
    return judged(scored, thresholds(scored, labels))
