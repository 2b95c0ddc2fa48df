"""Scores of classifications and clusterings, each from one pass over the rows or over a contingency table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators import kernels
from talus.operators.ordered import Cut, running


def _share(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def binary_scores(df: DataFrame, truth: Column, predicted: Column, by: list[str] = ()) -> DataFrame:
    """Accuracy, recall, precision, F1 and Jaccard index of boolean columns; 0/0 counts as 0."""
    tp, fp = F.count_if(truth & predicted), F.count_if(~truth & predicted)
    fn, tn = F.count_if(truth & ~predicted), F.count_if(~truth & ~predicted)
    counts = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        _share(tp + tn, tp + tn + fp + fn).alias("acc"), _share(tp, tp + fn).alias("recall"), _share(tp, tp + fp).alias("precision"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(tp, tp + fp + fn).alias("jaccard"),
    )


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[int]) -> DataFrame:
    """`truth, pred, n` for all pairs of the listed labels; rows of other labels do not count."""
    spark = df.sparkSession
    one = spark.createDataFrame([(x,) for x in labels], "truth int")
    # The listed labels are a parameter: their grid is small by construction.
    grid = one.withColumn("pred", F.explode(F.array(*[F.lit(x) for x in labels])))
    rows = df.where(F.col(truth).isin(labels) & F.col(predicted).isin(labels))
    counts = rows.groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def condense(cm: DataFrame, groups: DataFrame) -> DataFrame:
    """A confusion matrix between groups of labels (`groups`: label, grp)."""
    t = groups.select(F.col("label").alias("truth"), F.col("grp").alias("t"))
    p = groups.select(F.col("label").alias("pred"), F.col("grp").alias("p"))
    joined = cm.join(t, "truth").join(p, "pred")
    return joined.groupBy(F.col("t").alias("truth"), F.col("p").alias("pred")).agg(F.sum("n").alias("n"))


def normalized(cm: DataFrame) -> DataFrame:
    """Share of each row's total in per cent to two decimals; a row without support is 0."""
    total = F.sum("n").over(Window.partitionBy("truth"))
    return cm.withColumn("share", F.round(_share(F.lit(100.0) * F.col("n"), total), 2) + F.lit(0.0))


def precision_recall(df: DataFrame, truth: Column, score: Column, cut: Cut) -> DataFrame:
    """`threshold, precision, recall` for every distinct score; positives are scores at or above it.

    Scores are summed by ranges, so continuous ones need no single task; `cut` stores them where all executors can read.
    """
    counts = df.groupBy(score.alias("threshold")).agg(F.count_if(truth).alias("p"), F.count(F.lit(1)).alias("n"))
    found = running(counts, [], [F.desc("threshold")], {"tp": F.col("p"), "above": F.col("n")}, cut)
    return found.select("threshold", _share(F.col("tp"), F.col("above")).alias("precision"), _share(F.col("tp"), F.col("tp_all")).alias("recall"))


def multiclass_iou(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Intersection over union of every class that occurs on either side."""
    cm = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = cm.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("cls"), "t", "p", "n")
    same = (F.col("t") == F.col("p")) & (F.col("t") == F.col("cls"))
    return rows.groupBy("cls").agg(_share(F.sum(F.when(same, F.col("n")).otherwise(0)), F.sum("n")).alias("iou"))


def contingency(df: DataFrame, truth: str, cluster: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"))


def purity(df: DataFrame, truth: str, cluster: str, by: list[str] = ()) -> DataFrame:
    best = contingency(df, truth, cluster, by).groupBy(*by, "c").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.groupBy(*by).agg(_share(F.sum("top"), F.sum("n")).alias("purity"))


def mutual_information(df: DataFrame, truth: str, cluster: str, by: list[str] = ()) -> DataFrame:
    """Normalised mutual information, geometric mean of the entropies."""
    cells = contingency(df, truth, cluster, by)
    wt, wc, w = Window.partitionBy(*by, "t"), Window.partitionBy(*by, "c"), Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cells = cells.select(*by, "t", "c", "n", F.sum("n").over(wt).alias("nt"), F.sum("n").over(wc).alias("nc"), F.sum("n").over(w).alias("all"))
    n, nt, nc, every = (F.col(c).cast("double") for c in ("n", "nt", "nc", "all"))
    info = cells.groupBy(*by).agg(
        F.sum(n / every * F.ln(n * every / (nt * nc))).alias("mi"),
        F.sum(-n / every * F.ln(nt / every)).alias("ht"), F.sum(-n / every * F.ln(nc / every)).alias("hc"),
    )
    return info.select(*by, _share(F.col("mi"), F.sqrt(F.col("ht") * F.col("hc"))).alias("nmi"))


def adjusted_rand(df: DataFrame, truth: str, cluster: str, by: list[str] = ()) -> DataFrame:
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = contingency(df, truth, cluster, by).withColumn("__all", F.lit(0))
    keys = [*by, "__all"]
    both = cells.groupBy(*keys).agg(pairs(F.col("n")).alias("both"), F.sum("n").alias("n"))
    t = cells.groupBy(*keys, "t").agg(F.sum("n").alias("n")).groupBy(*keys).agg(pairs(F.col("n")).alias("pt"))
    c = cells.groupBy(*keys, "c").agg(F.sum("n").alias("n")).groupBy(*keys).agg(pairs(F.col("n")).alias("pc"))
    every = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("pt") * F.col("pc") / F.nullif(every, F.lit(0.0))
    most = (F.col("pt") + F.col("pc")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0)))
    return both.join(t, keys).join(c, keys).select(*by, ari.alias("ari"))


def best_assignment_accuracy(df: DataFrame, truth: str, cluster: str, by: str) -> DataFrame:
    """Share of rows that agree under the best one-to-one naming of clusters; a task holds one group's table of counts."""
    cells = contingency(df, truth, cluster, [by])

    def run(table: pa.Table) -> pa.Table:
        t, ti = np.unique(np.asarray(table.column("t")), return_inverse=True)
        c, ci = np.unique(np.asarray(table.column("c")), return_inverse=True)
        k = max(len(t), len(c))
        m = np.zeros((k, k), np.int64)
        np.add.at(m, (ti, ci), np.asarray(table.column("n")))
        best = m[np.arange(k), kernels.assignment(m)].sum()
        return pa.table({by: table.column(by).slice(0, 1), "accuracy": pa.array([best / m.sum()])})

    return cells.groupBy(by).applyInArrow(run, f"{by} {dict(df.dtypes)[by]}, accuracy double")
