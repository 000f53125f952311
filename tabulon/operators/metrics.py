"""Classifier metrics as aggregates of a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tabulon.functions.expressions import quoted
from tabulon.operators.bounded import pinned

SCORE_RANGES = 1_000
#: Classes that a confusion matrix has columns for.
MOST_CLASSES = 1_000


def area_under_roc(df: DataFrame, label: str, score: str, ranges: int = SCORE_RANGES) -> DataFrame:
    """Exact area under the ROC curve, tied scores counted half; rows without a
    label or with a score that is no number are left out.

    Labels are counted per distinct score. The scores are cut into ranges of
    similar size, pairs are counted within each range by its own task, and only
    the range totals are then accumulated in order.
    """
    scored = df.select(
        quoted(score).cast("double").alias("score"), (quoted(label) == 1).alias("positive")
    ).filter("score is not null and not isnan(score) and positive is not null")
    counts = scored.groupBy("score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    counts = pinned(counts)
    if counts.isEmpty():
        return df.sparkSession.sql("select cast(null as double) auc, 0L positives, 0L negatives")
    cut = QuantileDiscretizer(numBuckets=ranges, inputCol="score", outputCol="range").fit(counts)
    within = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(within), F.lit(0))
    per_range = (
        cut.transform(counts)
        .withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy("range")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("won") + F.col("pos") * F.coalesce(F.col("neg_before"), F.lit(0))
    positives, negatives = F.sum("pos"), F.sum("neg")
    return per_range.withColumn("neg_before", F.sum("neg").over(earlier)).agg(
        F.try_divide(F.sum(won), positives * negatives).alias("auc"),
        positives.alias("positives"), negatives.alias("negatives"),
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of hits among the rows that have a label and a prediction."""
    hit = quoted(label).cast("double") == quoted(prediction).cast("double")
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (actual, predicted) pair that occurs, pairs with a null left out."""
    actual, predicted = quoted(label).cast("double").alias("actual"), quoted(prediction).cast("double").alias("predicted")
    pairs = df.select(actual, predicted).filter("actual is not null and predicted is not null")
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))


def class_name(value: Column) -> Column:
    """Whole numbers without a fraction, others as they are."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: Sequence[float] | None = None
) -> DataFrame:
    """A row per actual class and a column per predicted class, zeros present.

    Without ``classes`` they are all that occur, actual or predicted; as each is
    a column, the driver holds their names and counts, in one job: at most ``MOST_CLASSES``
    classes. :func:`confusion_counts` has the long form for more.
    """
    counts = confusion_counts(df, label, prediction)
    most = MOST_CLASSES if classes is None else len(classes)
    if classes is not None:
        wanted = [float(c) for c in classes]
        counts = counts.filter(F.col("actual").isin(*wanted) & F.col("predicted").isin(*wanted)) if wanted else counts.limit(0)
    found = {(r["actual"], r["predicted"]): r["count"] for r in counts.limit(most**2 + 1).collect()}
    listed = sorted({c for pair in found for c in pair}) if classes is None else list(classes)
    if len(found) > most**2 or len(listed) > most:
        raise ValueError(f"more than {most} classes; take confusion_counts, or name the classes")
    names = [int(c) if float(c).is_integer() else float(c) for c in listed]
    if not names:
        return df.sparkSession.createDataFrame([], "actual int")
    wide = "int" if all(isinstance(n, int) and abs(n) < 2**31 for n in names) else "double"
    kind = int if wide == "int" else float
    rows = [(kind(a), *[found.get((float(a), float(p)), 0) for p in names]) for a in names]
    fields = [StructField("actual", IntegerType() if wide == "int" else DoubleType())]
    fields += [StructField(f"predicted_{n}", LongType()) for n in names]
    return df.sparkSession.createDataFrame(rows, StructType(fields))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the plain
    and support-weighted means. A ratio without cases is 0; rows without a label
    or a prediction are left out, as for the accuracy.

    The table is reduced to its confusion counts; the rest works on those.
    """
    n, zero = F.col("count"), F.lit(0).cast("long")

    def side(y, support, claimed, right):
        return F.struct(y.alias("y"), support.alias("support"), claimed.alias("claimed"), right.alias("right"))

    agreed = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    sides = confusion_counts(df, label, prediction).select(F.inline(F.array(
        side(F.col("actual"), n, zero, agreed), side(F.col("predicted"), zero, n, zero)
    )))
    right, support, claimed = F.col("right"), F.col("support"), F.col("claimed")

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    per_class = pinned(sides.groupBy("y").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("right").alias("right")
    ).select(
        class_name(F.col("y")).alias("class"),
        ratio(right, claimed).alias("precision"), ratio(right, support).alias("recall"),
        ratio(2 * right, claimed + support).alias("f1"), "support", "right",
    ))
    measures = ["precision", "recall", "f1"]
    summary = per_class.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("total"), F.sum("right").alias("right"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * support), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )
    nothing = F.lit(None).cast("double")

    def row(name, p, r, f):
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            F.col("total").alias("support"),
        )

    extra = [row("accuracy", nothing, nothing, ratio(F.col("right"), F.col("total")))]
    extra += [row(f"{k} avg", *[F.col(f"{k}_{m}") for m in measures]) for k in ("macro", "weighted")]
    return per_class.select("class", *measures, "support").unionByName(summary.select(F.inline(F.array(*extra))))


def weighted_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean of the class F1 values weighted by class size."""
    return class_report(df, label, prediction).filter("class = 'weighted avg'").select("f1")


def evaluate(df: DataFrame, label: str, prediction: str, score: str) -> dict[str, float]:
    """The three training metrics of a scored table."""
    report = {r["class"]: r["f1"] for r in class_report(df, label, prediction).filter("class in ('accuracy', 'weighted avg')").collect()}
    return {
        "auc": area_under_roc(df, label, score).first()["auc"],
        "accuracy": report["accuracy"],
        "f1": report["weighted avg"],
    }
