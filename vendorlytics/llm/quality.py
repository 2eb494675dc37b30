"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose measure exceeds a cutoff.  For every stratum
and rule, the cutoffs of a fixed grid are tested on labelled documents: of the n
good ones (quality 1) that pass the base rule, x exceed the cutoff.  The cutoff
is certified if a true false-rejection rate above ``alpha`` would give x or fewer
with probability at most ``delta / m`` (exact binomial tail, that is a
Clopper-Pearson bound), m being the number of tests over all strata, rules and
cutoffs (Bonferroni).  The lowest certified cutoff is selected.  With ``alpha`` =
``risk`` / number of rules, all rules together reject at most ``risk`` of the good
documents of each stratum, with confidence 1 - ``delta``.

DataFrame functions only.  Measures are taken per document row, labels meet them
by ``doc_id``, and counts by stratum, rule and grid cell are the only thing that
is gathered.

Defined results: a null or empty text measures 0 everywhere and fails the base
rule; a stratum is the document's ``lang`` (null is one too); a stratum without
certified cutoffs rejects nothing but what the base rule does; a document with
several labels is good if all are 1, null labels are ignored; labels without a
document are ignored; repeated documents are each measured and each counted.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.storage import stored

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RISK, DELTA = 0.05, 0.05
# Cutoffs to be tested, the strictest first; fixed, so that no data choose them.
GRID = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75),
    "repeat_word_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "chars_per_word": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0),
    "words_per_char": (0.125, 0.15, 0.175, 0.2, 0.225, 0.25, 0.3, 0.4),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The base counts of each whole text, beside the other columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    others = [F.col(c) for c in docs.columns if c not in {text, *BASE}]
    names = [c for c in docs.columns if c not in {text, *BASE}]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        *others, F.array_remove(F.split(t, SEPARATORS), "").alias("_w"), lines.alias("_lines"),
        F.length(F.regexp_replace(t, SEPARATORS, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"))
    w = lambda i: F.col("_w")[i]
    hashed = split.select(
        *names, "word_chars", "n_symbols", F.size("_w").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size("_lines").alias("n_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3),
                                              lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2)))).alias("_h"))
    # Only texts in which some window repeats are sorted: equal windows become neighbours.
    ordered = hashed.select(
        *names, *(c for c in BASE if c != "n_repeat_words"), F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    s = lambda k: F.get("_s", k)["h"]
    again = F.filter("_s", lambda x, k: F.coalesce(s(k - 1) == x["h"], F.lit(False))
                     | F.coalesce(s(k + 1) == x["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(
        again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    counts = {"n_repeat_words": F.coalesce(F.when(F.col("_s").isNotNull(), F.size(covered)), F.lit(0))}
    return ordered.select(*names, *(counts.get(c, F.col(c)).cast("long").alias(c) for c in BASE)).withColumn(
        "base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def rates() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
        "words_per_char": F.col("n_words") / chars,
    }


def log_factorial(k: Column) -> Column:
    """ln k!, exact up to 20, Stirling's series beyond."""
    x = k.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X ~ Binomial(n, p) where x is below the mean, else 1, which
    certifies nothing: the terms from x downwards, of which those further than 12
    standard deviations below no longer change the sum."""
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * log(p) + (n - x) * F.log(F.lit(1 - p))
    below = F.least(x, (F.sqrt(n * p * (1 - p)) * 12 + 100).cast("long"))
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), below), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (x - j) * odds / (n - x + j + 1)).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")))
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total["sum"]))


def tests(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK) -> DataFrame:
    """(stratum, rule, cutoff, n, x, p): good labelled documents and those above
    each cutoff of the grid, and the probability of x or fewer at the limit."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~F.col("base_failed")).join(good, "doc_id")
    cells = F.array(*(F.struct(F.lit(rule).alias("rule"), sum((value > c).cast("int") for c in GRID[rule]).alias("cell"))
                      for rule, value in rates().items()))
    counted = held.select(F.col(stratum).alias("stratum"), F.explode(cells).alias("x")) \
        .groupBy("stratum", "x.rule", "x.cell").agg(F.count("*").alias("n"))
    grid = F.create_map(*(v for rule, cs in GRID.items() for v in (F.lit(rule), F.array(*map(F.lit, cs)))))
    # A cell is the number of cutoffs exceeded: cutoff number i is exceeded by the cells above i.
    tested = counted.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("cell", "n")).alias("cells")) \
        .select("stratum", "rule", "n", "cells", F.posexplode(grid[F.col("rule")]).alias("i", "cutoff")) \
        .select("stratum", "rule", "cutoff", "n", F.aggregate(
            "cells", F.lit(0).cast("long"),
            lambda a, c: a + F.when(c["cell"] > F.col("i"), c["n"]).otherwise(0)).alias("x"))
    return tested.withColumn("p", binomial_tail(F.col("x"), F.col("n"), risk / len(GRID)))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang",
            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, <rule> ...): the selected cutoff of each rule, null where none is certified."""
    tested = stored(tests(measured, labels, stratum, risk), "threshold-tests")
    strata = tested.select("stratum").distinct().count()
    m = max(1, strata) * sum(map(len, GRID.values()))
    passed = tested.where(F.col("p") <= delta / m)
    return passed.groupBy("stratum").agg(*(
        F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule in GRID))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang",
          risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per document row: doc_id, the base counts, base_failed, failed_rules, kept."""
    measured = stored(measure(docs.select("doc_id", "text", F.col(stratum).alias("stratum"))), "measures")
    limits = stored(cutoffs(measured, labels, "stratum", risk, delta), "cutoffs")
    m, c = measured.alias("m"), limits.alias("c")
    failed = F.filter(F.array(*(F.when(value > F.col(f"c.{rule}"), F.lit(rule)) for rule, value in rates().items())),
                      lambda x: x.isNotNull())
    return m.join(c, F.col("m.stratum").eqNullSafe(F.col("c.stratum")), "left").select(
        "doc_id", *BASE, "base_failed", failed.alias("failed_rules")) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
