"""Quality rules: a decision list learnt by sequential covering.

A rule is a conjunction of thresholds on text statistics that marks documents of label 0.
Rules grow one threshold at a time by information gain on two thirds of the labelled rows,
are pruned from the end on the last third, and stand in order as one Spark conditional
expression.  Learning sees only counts by statistic and bin, summed by Spark over all
labelled rows; texts, statistics and rules are DataFrame expressions throughout.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tables as tables

BINS = 24
RULES = 8
CONDITIONS = 3
#: What a rule must reach on the labelled rows that it takes, grown on and pruned on: part of label 0, and rows of it.
PRECISION = 0.97
SUPPORT = 3

#: What thresholds are set on, as SQL over the counts of statistics().
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "stutter": "n_stutter / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, counts of its text and base_failed of each row; a null text has no words.

    Repeated words: every 3-word window is hashed (64 bits) and the hashes are sorted; only texts in which
    two are equal then sort them with their places.  All in the row; nothing is shuffled.
    """
    text = F.col("text")
    base = docs.select("doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    words = F.col("words")
    grams = F.when(
        F.size(words) >= 3,
        F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _count(text, "!?").alias("n_marks"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False)))).cast("bigint").alias("n_stutter"),
        grams.alias("grams"),
    )
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    base = base.withColumn("placed", F.when(repeats, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    placed = F.col("placed")
    twin = lambda p, i, by: F.coalesce(p["h"] == F.get(placed, i + by)["h"], F.lit(False))
    starts = F.transform(F.filter(placed, lambda p, i: twin(p, i, 1) | twin(p, i, -1)), lambda p: p["i"])
    base = base.withColumn("starts", F.when(placed.isNotNull(), starts)).drop("placed", "grams")
    covered = F.size(F.array_distinct(F.concat("starts", F.transform("starts", lambda i: i + 1), F.transform("starts", lambda i: i + 2))))
    base = base.withColumn("n_repeat_words", F.when(F.col("starts").isNotNull(), covered).otherwise(0).cast("bigint")).drop("starts")
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


class Condition:
    def __init__(self, feature: str, above: bool, threshold: float):
        self.feature, self.above, self.threshold = feature, above, threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


def _quality(bad: float, all_: float) -> float:
    return log2((bad + 1e-9) / all_) if all_ else -99.0


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value > c))


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules for label quality 0, from all labelled documents that no base rule fails.  Null labels and ids are skipped; no rules
    come of labels of one class."""
    spark = stats.sparkSession
    labelled = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = stats.where("not base_failed").join(labelled, "doc_id")
    rows = rows.select(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 1).otherwise(0).alias("fold"), (1 - F.col("quality")).alias("bad"), *(F.expr(f"cast({e} as double)").alias(n) for n, e in FEATURES.items()))
    rows = tables.written(rows)
    part = [i / BINS for i in range(1, BINS)]
    cut = lambda n, bad: F.percentile_approx(F.when(F.col("bad") == bad, F.col(n)), part, 10_000).alias(f"{n}_{bad}")
    got = rows.agg(*(cut(n, bad) for n in FEATURES for bad in (0, 1)), *(f(F.when(F.col("bad") == bad, F.col(n))).alias(f"{n}_{bad}_{f.__name__}") for n in FEATURES for bad in (0, 1) for f in (F.min, F.max))).first()
    if any(got[f"{n}_{bad}"] is None for n in FEATURES for bad in (0, 1)):
        return []
    cuts = {}
    for n in FEATURES:  # half-way between quantiles, least and greatest values of either class
        at = sorted({x for bad in (0, 1) for x in (*got[f"{n}_{bad}"], got[f"{n}_{bad}_min"], got[f"{n}_{bad}_max"])})
        cuts[n] = sorted({(a + b) / 2 for a, b in zip(at, at[1:])} or {at[0]})
    # bin k of a feature: above its first k cuts
    bins = rows.select("fold", "bad", *(_bin(F.col(n), cuts[n]).alias(n) for n in FEATURES))
    counts_of = bins.groupBy("fold", "bad", *FEATURES).agg(F.count("*").alias("n"))
    counts_of = tables.written(counts_of)
    stack = "stack({}, {}) as (feature, bin)".format(len(FEATURES), ", ".join(f"'{n}', {n}" for n in FEATURES))
    bin_sql = lambda c: f"{c.feature} {'>' if c.above else '<='} {cuts[c.feature].index(c.threshold)}"

    def counted(where: list[str]) -> dict:
        """Label-0 rows and all rows, by fold, feature and bin."""
        df = counts_of
        for w in where:
            df = df.where(w)
        out: dict = {}
        for fold, feature, b, bad, n in df.select("fold", "bad", "n", F.expr(stack)).groupBy("fold", "feature", "bin").agg(F.sum(F.col("bad") * F.col("n")), F.sum("n")).collect():
            out[fold, feature, b] = (bad, n)
        return out

    def total(got: dict, fold: int, keep=lambda b: True, feature: str = next(iter(FEATURES))) -> tuple[int, int]:
        hits = [v for (f, name, b), v in got.items() if f == fold and name == feature and keep(b)]
        return sum(v[0] for v in hits), sum(v[1] for v in hits)

    def conditions(got: dict):
        for feature, values in cuts.items():
            for k, c in enumerate(values):
                yield Condition(feature, True, c), lambda b, k=k: b > k
                yield Condition(feature, False, c), lambda b, k=k: b <= k

    rules: list[list[Condition]] = []
    left: list[str] = []  # what earlier rules do not take
    while len(rules) < RULES:
        rule: list[Condition] = []
        scores: list[tuple[float, int]] = []
        where = list(left)
        while len(rule) < CONDITIONS:
            got = counted(where)
            bad, n = total(got, 0)
            if bad < SUPPORT or bad == n:
                break
            best = None
            for c, keep in conditions(got):
                b, m = total(got, 0, keep, c.feature)
                gain = b * (_quality(b, m) - _quality(bad, n)) if b >= SUPPORT else 0
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, c, total(got, 1, keep, c.feature)
            if best is None:
                break
            rule.append(best[1])
            scores.append(((best[2][0] + 1) / (best[2][1] + 2), best[2][0]))
            where.append(bin_sql(best[1]))
        # prune: the shortest start of the rule whose part of label 0, on rows not grown on, is the best
        while len(scores) > 1 and scores[-2][0] >= scores[-1][0]:
            scores.pop(), rule.pop()
        if not rule:
            break
        where = [*left, *(bin_sql(c) for c in rule)]
        got = counted(where)
        (b0, n0), (b1, n1) = total(got, 0), total(got, 1)
        if b0 + b1 < SUPPORT or (b0 + b1) < PRECISION * (n0 + n1):
            break
        rules.append(rule)
        left.append("not (" + " and ".join(map(bin_sql, rule)) + ")")
    tables.drop(rows)
    tables.drop(counts_of)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that takes a row, from 1; 0 if none does."""
    out = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules):
        out = out.when(F.expr(" and ".join(c.sql() for c in rule)), k + 1)
    return out.otherwise(0)


def rule_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (that rejects, 0: none) and kept of each row of docs."""
    stats = tables.written(statistics(docs))
    rules = learn(stats, labels)
    return stats.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rule_verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
