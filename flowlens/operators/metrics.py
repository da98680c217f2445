"""Scoring reports.

Classification metrics start from one ``groupBy(truth, prediction).count()``
(partial aggregation: the shuffled table has at most classes^2 rows); all
per-class arithmetic then runs on that tiny table.  Histogram and KDE are
single-pass aggregates over the probabilities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.constants import (
    CLASS_NAMES,
    HISTOGRAM_BINS,
    KDE_GRID_POINTS,
    MODEL_ORDER,
    TARGET,
    TOP_FEATURES,
    UNRELIABLE_MISSING_RATIO,
)
from flowlens.operators.clean import col


# --- P5 -----------------------------------------------------------------------------


def class_name(c: Column) -> Column:
    """1 -> Attack, everything else (0, other classes, NULL) -> Normal."""
    return F.when(c == 1, F.lit(CLASS_NAMES[1])).otherwise(F.lit(CLASS_NAMES[0]))


def with_label_names(df: DataFrame, prediction: str = "prediction", truth: str | None = "true_label") -> DataFrame:
    out = df.withColumn("prediction_label", class_name(col(prediction)))
    if truth and truth in df.columns:
        out = out.withColumn("true_label_name", class_name(col(truth)))
    return out


# --- A4 ---------------------------------------------------------------------------


def traffic_summary(df: DataFrame, prediction: str = "prediction", probability: str | None = "attack_probability") -> DataFrame:
    """A4: totals, Normal/Attack counts and shares, mean attack probability (6 places)."""
    n = F.count(F.lit(1))
    n_attack = F.count(F.when(col(prediction) == 1, 1))
    n_normal = n - n_attack
    aggs = [
        n.alias("total"),
        n_normal.alias("n_normal"),
        n_attack.alias("n_attack"),
        F.when(n > 0, F.lit(100.0) * n_normal / n).alias("pct_normal"),
        F.when(n > 0, F.lit(100.0) * n_attack / n).alias("pct_attack"),
    ]
    if probability and probability in df.columns:
        aggs.append(F.bround(F.avg(col(probability)), 6).alias("mean_attack_probability"))
    return df.agg(*aggs)


# --- A5 / A6 ----------------------------------------------------------------------------


def probability_histogram(df: DataFrame, probability: str = "attack_probability", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """A5: ``bins`` equal-width bins over [min, max] (the max lands in the last bin).

    All bins are reported, empty ones with count 0; min = max gives one bin.
    """
    p = col(probability)
    vals = df.select(p.cast("double").alias("p")).filter(F.col("p").isNotNull() & ~F.isnan("p"))
    low, high = vals.agg(F.min("p"), F.max("p")).first()  # one row; the bounds are literals of the counting pass
    if low is None:
        return df.sparkSession.createDataFrame([], "bin INT, bin_lo DOUBLE, bin_hi DOUBLE, count BIGINT")
    n_bins = bins if high > low else 1
    mn, mx = F.lit(low), F.lit(high)
    width = mx - mn
    step = width / F.lit(float(bins))
    # bin index as a histogram over linspace edges assigns it: scaled index,
    # then one step down/up when the value falls outside its edges
    b0 = F.least(F.floor((F.col("p") - mn) * (F.lit(float(bins)) / width)), F.lit(bins - 1))
    lo_edge = mn + b0 * step
    hi_edge = mn + (b0 + 1) * step
    adjusted = (
        F.when(F.col("p") < lo_edge, b0 - 1)
        .when((b0 != bins - 1) & (F.col("p") >= hi_edge), b0 + 1)
        .otherwise(b0)
    )
    b = (adjusted if n_bins > 1 else F.lit(0)).cast("int")
    counts = vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.range(n_bins).select(
        F.col("id").cast("int").alias("bin"),
        (mn + F.col("id") * step).alias("bin_lo"),
        F.when(F.col("id") == n_bins - 1, mx).otherwise(mn + (F.col("id") + 1) * step).alias("bin_hi"),
    )
    return edges.join(counts, "bin", "left").select(
        "bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def probability_kde(
    df: DataFrame,
    probability: str = "attack_probability",
    grid_points: int = KDE_GRID_POINTS,
    bins: int = HISTOGRAM_BINS,
) -> DataFrame:
    """Gaussian KDE (Scott bandwidth, grid over [min, max]) of the probabilities.

    Values are first pre-aggregated to (value, weight): partial aggregation
    collapses repeated values map-side (rounded probabilities have at most
    10^4 + 1 distinct values).  Each distinct value then gets its kernel
    values over the grid as one array (``transform``, JVM-side), and the
    arrays are summed element-wise by one ``Summarizer.sum`` aggregate: no
    row is multiplied by the grid (unrounded input costs CPU, not rows) and
    each task returns one partial vector.
    ``count_scaled`` is the density scaled to the histogram's counts
    (n * bin width), as drawn over a count histogram.
    """
    p = col(probability).cast("double")
    vals = df.select(p.alias("p")).filter(F.col("p").isNotNull() & ~F.isnan("p"))
    stats = vals.agg(
        F.min("p").alias("mn"),
        F.max("p").alias("mx"),
        F.stddev_samp("p").alias("sd"),
        F.count(F.lit(1)).alias("n"),
    ).first()  # one row
    schema = "grid_index INT, x DOUBLE, density DOUBLE, count_scaled DOUBLE"
    if stats is None or not stats["n"] or stats["sd"] is None or stats["sd"] == 0 or math.isnan(stats["sd"]):
        return df.sparkSession.createDataFrame([], schema)
    mn, mx, sd, n = float(stats["mn"]), float(stats["mx"]), float(stats["sd"]), int(stats["n"])
    h = sd * math.pow(n, -0.2)
    step = (mx - mn) / (grid_points - 1)
    last = grid_points - 1
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    weighted = vals.groupBy("p").agg(F.count(F.lit(1)).alias("w"))

    def grid_x(i: Column) -> Column:
        return F.when(i == last, F.lit(mx)).otherwise(F.lit(mn) + i * F.lit(step))

    kernels = F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.col("w") * F.exp(F.lit(-0.5) * F.pow((grid_x(i) - F.col("p")) / F.lit(h), 2)),
    )
    summed = weighted.select(array_to_vector(kernels).alias("kv")).agg(Summarizer.sum(F.col("kv")).alias("kv"))
    sums = summed.select(F.posexplode(vector_to_array("kv")).alias("grid_index", "k")).select(
        "grid_index", grid_x(F.col("grid_index")).alias("x"), "k"
    )
    norm = n * h * math.sqrt(2.0 * math.pi)
    scale = n * (mx - mn) / bins
    return sums.select(
        F.col("grid_index").cast("int").alias("grid_index"),
        F.bround(F.col("x"), 6).alias("x"),
        F.bround(F.col("k") / F.lit(norm), 6).alias("density"),
        F.bround(F.col("k") / F.lit(norm) * F.lit(scale), 6).alias("count_scaled"),
    )


# --- A7-A9 ---------------------------------------------------------------------------------


def pair_counts(df: DataFrame, truth: str = "true_label", prediction: str = "prediction") -> DataFrame:
    """(truth, prediction, n): the only pass over the scored rows."""
    return df.groupBy(col(truth).alias("t"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, truth: str = "true_label", prediction: str = "prediction", fixed_labels: bool = True
) -> DataFrame:
    """TN/FP/FN/TP for classes 0/1.

    ``fixed_labels=False`` follows the evaluation report: when the observed
    labels (truth and prediction together) are not exactly two classes the
    matrix is reported as zeros.
    """
    t, p = col(truth), col(prediction)
    cells = {
        "true_negative": (t == 0) & (p == 0),
        "false_positive": (t == 0) & (p == 1),
        "false_negative": (t == 1) & (p == 0),
        "true_positive": (t == 1) & (p == 1),
    }
    if fixed_labels:
        return df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in cells.items()])
    pc = pair_counts(df, truth, prediction)
    labels = pc.select(F.col("t").alias("c")).union(pc.select(F.col("p").alias("c"))).distinct()
    k = labels.select(F.count(F.lit(1))).scalar()
    tt, pp = F.col("t"), F.col("p")
    cells2 = {
        "true_negative": (tt == 0) & (pp == 0),
        "false_positive": (tt == 0) & (pp == 1),
        "false_negative": (tt == 1) & (pp == 0),
        "true_positive": (tt == 1) & (pp == 1),
    }
    return pc.agg(
        *[
            F.when(k == 2, F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(name)
            for name, c in cells2.items()
        ]
    )


def per_class_metrics(df: DataFrame, truth: str = "true_label", prediction: str = "prediction") -> DataFrame:
    """Per class: support, predicted count, true positives, precision, recall, F1.

    Classes are the union of observed truth and prediction values; a zero
    denominator gives 0 (``zero_division=0``).  Unrounded.
    """
    pc = pair_counts(df, truth, prediction)
    none = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("p").alias("class"), none.alias("support"), F.col("n").alias("predicted"), none.alias("tp")),
    )
    m = pc.select(F.inline(sides)).groupBy("class").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("support", "predicted", "tp")]
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    denom = F.col("support") + F.col("predicted")
    f1 = F.when(denom > 0, F.lit(2.0) * F.col("tp") / denom).otherwise(F.lit(0.0))
    return m.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"))


def weighted_metrics(df: DataFrame, truth: str = "true_label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1, each rounded to 4 places."""
    m = per_class_metrics(df, truth, prediction)
    total = F.sum("support")
    return m.agg(
        F.bround(F.sum("tp") / total, 4).alias("accuracy"),
        F.bround(F.sum(F.col("precision") * F.col("support")) / total, 4).alias("precision_weighted"),
        F.bround(F.sum(F.col("recall") * F.col("support")) / total, 4).alias("recall_weighted"),
        F.bround(F.sum(F.col("f1_score") * F.col("support")) / total, 4).alias("f1_weighted"),
    )


def classification_report(
    df: DataFrame, truth: str = "true_label", prediction: str = "prediction", digits: int = 4
) -> DataFrame:
    """Per-class rows and the rows ``accuracy``, ``macro avg`` and ``weighted avg``.

    The accuracy row carries the accuracy in ``f1_score`` and the total in
    ``support`` (the text-report layout).  A rollup over the classes gives the
    class rows and the overall one together: one scan of the scored table.
    An empty table gives no rows.
    """
    m = per_class_metrics(df, truth, prediction)
    scores = ("precision", "recall", "f1_score")
    total = F.sum("support")
    every = m.rollup("class").agg(
        F.grouping("class").alias("overall"),
        total.cast("long").alias("support"),
        (F.sum("tp") / total).alias("accuracy"),
        *[F.avg(c).alias(c) for c in scores],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in scores],
    )

    def line(name, *values):
        rounded = [F.bround(v, digits).cast("double").alias(c) for v, c in zip(values, scores)]
        return F.struct(name.cast("string").alias("class"), *rounded, F.col("support").alias("support"))

    means = [F.col(c) for c in scores]
    lines = F.when(F.col("overall") == 0, F.array(line(F.col("class"), *means))).otherwise(
        F.array(
            line(F.lit("accuracy"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("accuracy")),
            line(F.lit("macro avg"), *means),
            line(F.lit("weighted avg"), *[F.col(f"weighted_{c}") for c in scores]),
        )
    )
    return every.select(F.inline(lines))


def evaluation_report(df: DataFrame, truth: str = "true_label", prediction: str = "prediction") -> dict:
    """The nested evaluation dict (accuracy, weighted P/R/F1, confusion matrix, report).

    Three tiny aggregates are collected; the scored rows never leave the cluster.
    """
    w = weighted_metrics(df, truth, prediction).first()
    cm = confusion_matrix(df, truth, prediction, fixed_labels=False).first()
    rep = {}
    for row in classification_report(df, truth, prediction).collect():
        if row["class"] == "accuracy":
            rep["accuracy"] = row["f1_score"]
        else:
            rep[row["class"]] = {
                "precision": row["precision"],
                "recall": row["recall"],
                "f1-score": row["f1_score"],
                "support": float(row["support"]),
            }
    return {
        "accuracy": w["accuracy"],
        "precision_weighted": w["precision_weighted"],
        "recall_weighted": w["recall_weighted"],
        "f1_weighted": w["f1_weighted"],
        "confusion_matrix": {k: int(cm[k]) for k in ("true_negative", "false_positive", "false_negative", "true_positive")},
        "classification_report": rep,
    }


# --- A10 ----------------------------------------------------------------------------


def alignment_report(expected: list[str], missing: list[str], extra: list[str]) -> dict:
    """A10: share of expected features that were zero-filled; above 50 % is unreliable."""
    ratio = len(missing) / len(expected) if expected else 0.0
    return {
        "n_expected": len(expected),
        "n_missing": len(missing),
        "n_extra": len(extra),
        "missing_ratio": ratio,
        "unreliable": ratio > UNRELIABLE_MISSING_RATIO,
    }


# --- T2 / T3 ----------------------------------------------------------------------------


def top_features(importances: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The ``n`` largest importances (ties by feature name): one TakeOrderedAndProject."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def class_mean_gaps(df: DataFrame, target: str = TARGET, digits: int = 4) -> DataFrame:
    """(feature, importance): how far the two classes' means of each numeric column lie apart.  One aggregate."""
    features = [c for c in df.columns if c != target]
    mean = lambda c, k: F.coalesce(F.avg(F.when(col(target) == k, col(c).cast("double"))), F.lit(0.0))
    gaps = df.agg(*[F.bround(F.abs(mean(c, 1) - mean(c, 0)), digits).alias(f"g{i}") for i, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"g{i}").alias("importance")) for i, c in enumerate(features)])
    return gaps.select(F.inline(pairs))


def best_model(results: DataFrame) -> DataFrame:
    """The row with the best weighted F1; ties go to the earlier model in the fixed order."""
    order = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    return results.orderBy(F.col("f1_score").desc(), order).limit(1)


# --- M0 ----------------------------------------------------------------------------


def class_weight_table(df: DataFrame, target: str) -> DataFrame:
    """M0: per class, balanced weight n / (k * n_class)."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target).alias(target)).agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy()  # one row per class meets here
    n, k = F.sum("count").over(every), F.count(F.lit(1)).over(every)
    return counts.select(target, "count", (n.cast("double") / (k * F.col("count"))).alias("weight"))


def with_class_weights(df: DataFrame, target: str, weight_col: str = "weight") -> DataFrame:
    """Attach balanced class weights by an equi-join to the class table; a row without a class weighs 0."""
    table = class_weight_table(df, target).select(col(target).alias("_class"), F.col("weight").alias("_class_weight"))
    rows = df.join(table, col(target) == F.col("_class"), "left")
    return rows.withColumn(weight_col, F.coalesce("_class_weight", F.lit(0.0))).drop("_class", "_class_weight")
