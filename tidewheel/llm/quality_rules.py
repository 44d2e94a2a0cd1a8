"""Quality rules whose cutoffs are set by risk control on a labelled holdout.

Signals are counted over whole texts with DataFrame functions only. For each stratum and rule the
cutoffs of a fixed grid are tested from the most lenient to the strictest: a cutoff passes when
the exact binomial (Clopper-Pearson) upper bound on its share of good documents rejected is at most
``alpha / rules``. Fixed-sequence testing needs no correction along the grid; over strata and rules
the level is ``delta / (strata * rules)`` (Bonferroni). So with probability ``1 - delta`` no stratum
loses more than ``alpha`` of its good documents. A stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import NOT_WS, WS, materialize, text_or_empty, words

#: Rules: a signal and its grid of cutoffs; a document fails where the signal is above the cutoff.
RULES = {
    "symbol_share": [0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05],
    "dup_line_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20],
    "repeat_share": [0.30, 0.28, 0.26, 0.24, 0.22, 0.20, 0.18, 0.16, 0.14, 0.12],
    "mean_word_chars": [30.0, 25.0, 22.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0],
}
SYMBOLS = "#*$%&|<>"
SPAN = 8
STRATA_BROADCAST = 10_000


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.col("t")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(strata).cast("string"), F.lit("")).alias("stratum"), text_or_empty(text_col).alias("t"))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_WS))
    d = d.select(
        "doc_id",
        "stratum",
        F.length(F.regexp_replace(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words("t"), lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.when(
        F.size("h") > SPAN, F.transform(F.sequence(F.lit(1), F.size("h") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("h", i, SPAN)))
    )
    d = d.select(
        "doc_id",
        "stratum",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("h").cast("long").alias("n_words"),
        windows.alias("win"),
    )
    repeats = F.size("win") > F.size(F.array_distinct("win"))
    d = d.withColumn("win", F.when(repeats, F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    d = d.withColumn(
        "win",
        F.array_sort(
            F.transform(
                F.filter("win", lambda s, j: (s["x"] == F.get("win", j - 1)["x"]) | (s["x"] == F.get("win", j + 1)["x"])), lambda s: s["i"]
            )
        ),
    )
    covered = F.aggregate(
        "win",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-SPAN).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(SPAN), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("win")


def rule_values() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def binomial_cdf(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X ~ Binomial(n, p), summed in logs; only needed for x below n * p."""
    step = math.log(p) - math.log1p(-p)
    first = F.struct((n * math.log1p(-p)).alias("log_term"), F.lit(0.0).alias("total"))

    def add(a: Column, k: Column) -> Column:
        return F.struct((a["log_term"] + F.ln((n - k) / (k + 1)) + step).alias("log_term"), (a["total"] + F.exp(a["log_term"])).alias("total"))

    return F.aggregate(F.sequence(F.lit(0), x.cast("int")), first, add)["total"]


def thresholds(labelled: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_rejected for the rules that have a safe cutoff.

    ``labelled``: the columns of ``signals`` for good documents of the holdout.
    """
    values = rule_values()
    counts = [F.sum((values[r] > c).cast("long")).alias(f"{r}_{k}") for r, grid in RULES.items() for k, c in enumerate(grid)]
    per = labelled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *counts)
    grid = F.array(
        *(
            F.struct(F.lit(r).alias("rule"), F.lit(k).alias("k"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{k}").alias("n_rejected"))
            for r, cutoffs in RULES.items()
            for k, c in enumerate(cutoffs)
        )
    )
    per = per.withColumn("n_strata", F.count(F.lit(1)).over(W.partitionBy()))
    rows = per.select("stratum", "n_good", "n_strata", F.inline(grid))
    risk = alpha / len(RULES)
    n, x = F.col("n_good"), F.col("n_rejected")
    passed = F.when(x < n * risk, binomial_cdf(x, n, risk) <= delta / (F.col("n_strata") * len(RULES))).otherwise(F.lit(False))
    order = W.partitionBy("stratum", "rule").orderBy("k")
    safe = rows.withColumn("ok", F.min(passed).over(order)).where("ok")
    return safe.groupBy("stratum", "rule").agg(
        F.min("cutoff").alias("cutoff"), F.first("n_good").alias("n_good"), F.max_by("n_rejected", "k").alias("n_rejected")
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata: str = "lang",
    alpha: float = 0.05,
    delta: float = 0.05,
) -> DataFrame:
    """One row for each document: its signals, base_failed, kept and the rules that it failed.

    ``labels``: doc_id and quality (1: good). Null and empty texts have no words and fail the base
    rule. A null stratum is the stratum of the empty string. Labels without a document, null labels and
    documents without a label set no cutoff; repeated labels of a document count once, as good
    only if all say so. Other columns are not read.
    """
    found = materialize(signals(docs, id_col, text_col, strata), "signals")
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    cut = materialize(thresholds(found.join(good, "doc_id"), alpha, delta), "cutoffs")
    wide = cut.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    if wide.count() <= STRATA_BROADCAST:
        wide = F.broadcast(wide)
    values = rule_values()
    failed = F.array_compact(F.array(*(F.when(v > F.col(r), F.lit(r)) for r, v in values.items())))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        found.join(wide, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("failed_rules", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
        )
    )
