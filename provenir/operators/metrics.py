"""Evaluation of scored rows (group, truth, score, pred): 1 is human, the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.operators.quantiles import exact_quantiles



def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of the human class per group."""
    t, p = F.col("truth"), F.col("pred")
    return rows.where("truth is not null and pred is not null").groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"))


def per_class(rows: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; a ratio without denominator is 0."""
    c = confusion(rows, by)
    sides = F.array(
        F.struct(F.lit("human").alias("class"), F.col("tp").alias("hit"), (F.col("tp") + F.col("fp")).alias("said"), (F.col("tp") + F.col("fn")).alias("support")),
        F.struct(F.lit("lm").alias("class"), F.col("tn").alias("hit"), (F.col("tn") + F.col("fn")).alias("said"), (F.col("tn") + F.col("fp")).alias("support")))
    x = c.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    x = x.withColumn("precision", _ratio(F.col("hit"), F.col("said"))).withColumn("recall", _ratio(F.col("hit"), F.col("support")))
    return x.select(*by, "class", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"), "support")


def auroc(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where a class is missing.

    Scores are counted before the running sum, so the window goes over the
    distinct scores of a group and not over its rows.
    """
    w = F.col(weight) if weight else F.lit(1)
    at = rows.where("score is not null and truth is not null").groupBy(*by, "score").agg(F.sum(F.when(F.col("truth") == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col("truth") == 0, w).otherwise(0)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = at.withColumn("area", F.col("p") * (below + F.col("n") / 2))
    return area.groupBy(*by).agg(F.sum("area").alias("area"), F.sum("p").alias("pos"), F.sum("n").alias("neg")).select(*by, F.try_divide("area", F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auroc"), "pos", "neg")


def roc_curve(rows: DataFrame, by: list[str]) -> DataFrame:
    """A point for each distinct score of a group: false and true positive rate at that threshold and above."""
    at = rows.where("score is not null and truth is not null").groupBy(*by, F.col("score").alias("threshold")).agg(F.count_if(F.col("truth") == 1).alias("p"), F.count_if(F.col("truth") == 0).alias("n"))
    group, down = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("threshold"))
    return at.select(*by, "threshold", F.try_divide(F.sum("n").over(down), F.nullif(F.sum("n").over(group), F.lit(0))).alias("fpr"), F.try_divide(F.sum("p").over(down), F.nullif(F.sum("p").over(group), F.lit(0))).alias("tpr"))


def cell_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: accuracy, both classes' F1, their mean, true positive and negative rates, AUROC."""
    c = confusion(rows, by)
    p1, r1 = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    p0, r0 = _ratio(F.col("tn"), F.col("tn") + F.col("fn")), _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    x = c.select(
        *by, ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("tpr"), (F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1))).alias("tnr"),
        _f1(p1, r1).alias("human_f1"), _f1(p0, r0).alias("lm_f1"))
    return x.withColumn("avg_f1", (F.col("human_f1") + F.col("lm_f1")) / 2).join(auroc(rows, by).select(*by, "auroc"), by, "left")


def sweep(rows: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """cell metrics of pred = score >= threshold for every threshold, in one pass over the counts of each score."""
    at = rows.where("score is not null and truth is not null").groupBy(*by, "score").agg(F.count_if(F.col("truth") == 1).alias("p"), F.count_if(F.col("truth") == 0).alias("n"))
    cells = at.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    up = F.col("score") >= F.col("threshold")
    c = cells.groupBy(*by, "threshold").agg(F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~up, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(~up, F.col("n")).otherwise(0)).alias("tn"))
    p1, r1 = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    p0, r0 = _ratio(F.col("tn"), F.col("tn") + F.col("fn")), _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    x = c.select(*by, "threshold", p0.alias("lm_precision"), r0.alias("lm_recall"), _f1(p1, r1).alias("human_f1"), _f1(p0, r0).alias("lm_f1"))
    return x.withColumn("avg_f1", (F.col("human_f1") + F.col("lm_f1")) / 2)


def best_threshold(swept: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with the best mean F1, then lm F1, then lm precision; the first of equals."""
    key = F.struct(*[F.round(c, 12) for c in ("avg_f1", "lm_f1", "lm_precision")], -F.col("threshold"))
    return swept.groupBy(*by).agg(F.max_by("threshold", key).alias("threshold"), F.max_by("avg_f1", key).alias("avg_f1"))


def classifier_gains(cells: DataFrame) -> DataFrame:
    """From cells (classifier, dataset, threshold, default, tuned): a row per classifier with its cells' means, and the one best cell of all by tuned (level best; the first of equals by name)."""
    c = cells.withColumn("delta", F.col("tuned") - F.col("default"))
    means = c.groupBy("classifier").agg(F.count("*").alias("cells"), *(F.avg(x).alias(x) for x in ("default", "tuned", "delta")))
    best = c.orderBy(F.desc("tuned"), "classifier", "dataset").limit(1)
    none = [F.lit(None).cast(c.schema[x].dataType).alias(x) for x in ("dataset", "threshold")]
    columns = ["level", "classifier", "dataset", "threshold", "cells", "default", "tuned", "delta"]
    return means.select("*", *none, F.lit("classifier").alias("level")).select(columns).union(best.select("*", F.lit(1).cast("bigint").alias("cells"), F.lit("best").alias("level")).select(columns))


def paired_deltas(rows: DataFrame, pair: str, before: str, after: str) -> DataFrame:
    """From rows (subset, pair, condition, truth, score): pairs, both conditions' AUROC and after less before per subset."""
    at = auroc(rows, ["subset", "condition"])
    pick = lambda c: F.max(F.when(F.col("condition") == c, F.col("auroc")))
    n = rows.groupBy("subset").agg(F.count_distinct(pair).alias("pairs"))
    return n.join(at.groupBy("subset").agg(pick(before).alias("before"), pick(after).alias("after")), "subset").withColumn("delta", F.col("after") - F.col("before"))


def proba_grid() -> list[float]:
    """0.30 to 0.70 in steps of 0.02."""
    return [round(0.30 + 0.02 * i, 2) for i in range(21)]


def decision_grid(rows: DataFrame, points: int = 41, reach: float = 1.5) -> list[float]:
    """Evenly from reach population deviations below the median score to as many above."""
    (m,), s = exact_quantiles(rows, "score", [0.5]), rows.agg(F.stddev_pop("score")).first()[0]
    return [] if m is None else [m - reach * s + 2 * reach * s * i / (points - 1) for i in range(points)]


def cohens_d(rows: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """Difference of the two sides' means over their pooled sample deviation (side is 1 or 0)."""
    one, other = F.when(F.col(side) == 1, F.col(value)), F.when(F.col(side) == 0, F.col(value))
    a = rows.groupBy(*by).agg(F.avg(one).alias("a"), F.avg(other).alias("b"), F.var_samp(one).alias("va"), F.var_samp(other).alias("vb"))
    return a.select(*by, F.try_divide(F.col("a") - F.col("b"), F.nullif(F.sqrt((F.col("va") + F.col("vb")) / 2), F.lit(0.0))).alias("d"))


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sample deviation, extremes and the 10th to 90th percentiles (linear between neighbours)."""
    points = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = F.percentile(value, F.array(*map(F.lit, points)))
    a = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    return a.select(*by, "n", "mean", "std", "least", "most", *(F.col("q")[i].alias(f"p{int(100 * p)}") for i, p in enumerate(points)))
