"""Evaluation of predicted networks against the truth, from judge replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.staging import written


def valid_matches(matches: DataFrame) -> DataFrame:
    """Judge rows (sg_id, match_pos, predicted, ground_truth, score) with a positive score and both names."""
    return matches.where("score > 0 and predicted is not null and ground_truth is not null")


def canonical_matches(matches: DataFrame) -> DataFrame:
    """canonical: whether a row is the first of its ground truth; the others are extras."""
    order = Window.partitionBy("sg_id", "ground_truth").orderBy("match_pos")
    return valid_matches(matches).withColumn("canonical", F.row_number().over(order) == 1)


def node_metrics(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes (sg_id, n_gt, n_pred) to node metrics; extras don't lower the precision, unmatched predictions do."""
    n = canonical_matches(matches).groupBy("sg_id").agg(F.sum(F.col("canonical").cast("long")).alias("n_matched"), F.sum((~F.col("canonical")).cast("long")).alias("n_extra"))
    met = sizes.join(n, "sg_id", "left").fillna(0, ["n_matched", "n_extra"])
    met = met.withColumn("n_pred_eff", F.greatest(F.col("n_pred") - F.col("n_extra"), F.col("n_matched")))
    f1, p, r = N.precision_recall_f1(F.col("n_matched"), F.col("n_gt"), F.col("n_pred_eff"))
    share = N.rounded(F.coalesce(F.try_divide(F.col("n_matched") * 100.0, F.col("n_gt")), F.lit(0.0)), 1)
    return met.select("sg_id", "n_gt", "n_pred", "n_matched", "n_extra", "n_pred_eff", f1.alias("node_f1"), p.alias("node_precision"), r.alias("node_recall"), share.alias("pct_nodes_matched"))


def state_metrics(nodes: DataFrame) -> DataFrame:
    """nodes (sg_id, node, gt_states, pred_states, n_matched) to (sg_id, state_f1, state_precision, state_recall, pct_states_matched).

    n_matched null: the judge failed, and equal states in any case count. Nodes without true states are
    skipped; nodes without predicted ones count as zeros. Means are over nodes, the share over all states.
    """
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    same = F.size(F.array_intersect(low("gt_states"), low("pred_states"))).cast("long")
    n = nodes.where(F.size("gt_states") > 0).withColumn("m", F.when(F.size("pred_states") == 0, 0).otherwise(F.coalesce(F.col("n_matched"), same)))
    f1, p, r = N.precision_recall_f1(F.col("m"), F.size("gt_states"), F.size("pred_states"))
    n = n.select("sg_id", "m", F.size("gt_states").alias("g"), f1.alias("f1"), p.alias("p"), r.alias("r"))
    mean = lambda c: N.rounded(F.sum(N.rounded(F.col(c) * 10000, 0).cast("long")) / F.lit(10000.0) / F.count(F.lit(1)), 4)
    return n.groupBy("sg_id").agg(mean("f1").alias("state_f1"), mean("p").alias("state_precision"), mean("r").alias("state_recall"),
                                  N.rounded(F.sum("m") * F.lit(100.0) / F.sum("g"), 1).alias("pct_states_matched"))


def mapped_edges(predicted: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct predicted edges (sg_id, parent, child) in true names (names: sg_id, predicted, ground_truth); both ends must map."""
    a = names.select("sg_id", F.col("predicted").alias("parent"), F.col("ground_truth").alias("to_parent"))
    b = names.select("sg_id", F.col("predicted").alias("child"), F.col("ground_truth").alias("to_child"))
    met = predicted.join(a, ["sg_id", "parent"]).join(b, ["sg_id", "child"])
    return met.select("sg_id", F.col("to_parent").alias("parent"), F.col("to_child").alias("child")).distinct()


def edge_metrics(truth: DataFrame, predicted: DataFrame, names: DataFrame) -> DataFrame:
    """Edge metrics of each sg_id of truth; predicted edges with an end that doesn't map don't count at all."""
    gt = truth.select("sg_id", "parent", "child").distinct()
    pred = mapped_edges(predicted, names)
    both = gt.withColumn("g", F.lit(1)).join(pred.withColumn("q", F.lit(1)), ["sg_id", "parent", "child"], "full")
    one = lambda c: F.col(c).isNotNull()
    n = both.groupBy("sg_id").agg(F.sum(one("g").cast("long")).alias("n_gt_edges"), F.sum(one("q").cast("long")).alias("n_pred_edges"), F.sum((one("g") & one("q")).cast("long")).alias("n_correct_edges"))
    n = n.withColumn("n_spurious_edges", F.col("n_pred_edges") - F.col("n_correct_edges"))
    f1, p, r = N.precision_recall_f1(F.col("n_correct_edges"), F.col("n_gt_edges"), F.col("n_pred_edges"))
    share = lambda a, b: N.rounded(F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0)), 1)
    return n.select("sg_id", "n_gt_edges", "n_pred_edges", "n_correct_edges", "n_spurious_edges", f1.alias("edge_f1"), p.alias("edge_precision"), r.alias("edge_recall"),
                    share("n_correct_edges", "n_gt_edges").alias("pct_correct_edges"), share("n_spurious_edges", "n_pred_edges").alias("pct_spurious_edges"))


def matrices(cpd: DataFrame) -> DataFrame:
    """(sg_id, parent, child, m): rows are child states, columns parent states, by position; from (…, ps_pos, state_pos, p)."""
    row = cpd.groupBy("sg_id", "parent", "child", "state_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("ps_pos", "p"))), lambda x: x["p"]).alias("row"))
    return row.groupBy("sg_id", "parent", "child").agg(F.transform(F.array_sort(F.collect_list(F.struct("state_pos", "row"))), lambda x: x["row"]).alias("m"))


def cpd_divergence(truth: DataFrame, predicted: DataFrame, predicted_dims: bool = False, need_both: bool = True) -> DataFrame:
    """matrix_divergence of tables of a row a cell."""
    return matrix_divergence(matrices(truth), matrices(predicted), predicted_dims, need_both)


def matrix_divergence(truth: DataFrame, predicted: DataFrame, predicted_dims: bool = False, need_both: bool = True) -> DataFrame:
    """(sg_id, parent, child, kl, kl_symmetric) of the edges that both have, from matrices (sg_id, parent, child, m).

    The reverse divergence uses the true matrix's size, or the predicted one's (predicted_dims); without
    it the symmetric value is null, or the forward one (need_both false).
    """
    met = truth.withColumnRenamed("m", "t").join(predicted.withColumnRenamed("m", "q"), ["sg_id", "parent", "child"])
    size = lambda m: (F.size(m), F.coalesce(F.size(F.get(F.col(m), 0)), F.lit(0)))
    forward = N.column_kl(F.col("t"), F.col("q"), *size("t"))
    back = N.column_kl(F.col("q"), F.col("t"), *size("q" if predicted_dims else "t"))
    met = met.withColumns({"kl": forward, "back": back})
    both = N.rounded((F.col("kl") + F.col("back")) / 2, 6)
    return met.select("sg_id", "parent", "child", "kl", (both if need_both else F.coalesce(both, F.col("kl"))).alias("kl_symmetric"))


def table_divergence(met: DataFrame, predicted_dims: bool = False, need_both: bool = True) -> DataFrame:
    """(sg_id, cpd_kl, cpd_kl_symmetric, n_cpd_evaluated): means over the edges (sg_id, m, q, t_parent, t_child) of a subgraph.

    m and q are the true and the predicted matrix, t_* the numbers of true states. An edge without a
    column counts in neither mean; with need_both, nor does one whose reverse has none.
    """
    size = (F.col("t_child"), F.col("t_parent"))
    back_size = (F.size("q"), F.coalesce(F.size(F.get("q", 0)), F.lit(0))) if predicted_dims else size
    each = met.select("sg_id", N.column_kl(F.col("m"), F.col("q"), *size).alias("kl"), N.column_kl(F.col("q"), F.col("m"), *back_size).alias("back"))
    both = (F.col("kl") + F.col("back")) / 2
    each = each.withColumn("both", both if need_both else F.coalesce(both, F.col("kl"))).where("kl is not null" + (" and back is not null" if need_both else ""))
    # sums of whole micro-units don't depend on their order
    micro = lambda c: F.sum(F.floor(F.col(c) * 1e6 + 0.5)) / 1e6 / F.count(c)
    return each.groupBy("sg_id").agg(N.rounded(micro("kl"), 6).alias("cpd_kl"), N.rounded(micro("both"), 6).alias("cpd_kl_symmetric"), F.count(F.lit(1)).alias("n_cpd_evaluated"))


def mean_and_std(x: str, places: int = 4) -> tuple[Column, Column]:
    """Mean and population deviation of the values there are."""
    return N.rounded(F.avg(x), places), N.rounded(F.stddev_pop(x), places)


def aggregate(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: total, and mean and deviation of each metric; rows with errors count in the total."""
    out = [F.count(F.lit(1)).alias("total")]
    for m in metrics:
        mean, std = mean_and_std(m)
        out += [mean.alias(f"{m}_mean"), std.alias(f"{m}_std")]
    return results.agg(*out)


def by_size(results: DataFrame, metric: str, size: str = "n_nodes") -> DataFrame:
    """(size, value, n): how often each size has a value, rounded to 4 places; nulls are left out.

    A size has at most 10,001 rows of a share, however many results there are.
    """
    kept = results.where(F.col(size).isNotNull() & F.col(metric).isNotNull())
    return kept.groupBy(size, N.rounded(F.col(metric), 4).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def running_counts(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, upto, total): the distinct values of a group with how often they occur, how many rows are no larger, and all.

    Ranges of (group, value) make the tasks, so no task orders a whole group; counts run within ranges and
    over ranges. The ranges are written before both branches read them.
    """
    counted = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    spread = written(counted.repartitionByRange(F.col(group), F.col(value)).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spread.groupBy(group, "part").agg(F.sum("n").alias("m"))
    ranges = ranges.select(group, "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(group)).alias("total"))
    return spread.withColumn("inside", F.sum("n").over(inside)).join(ranges, [group, "part"]).select(group, value, "n", (F.col("before") + F.col("inside")).alias("upto"), "total")


def quantile(value: str, share: float) -> Column:
    """Over the running counts of a group: the value at a share of the way from the first row to the last, between rows linearly."""
    place = (F.col("total") - 1) * F.lit(share)
    low, high = (F.min(F.when(F.col("upto") > f(place), F.col(value))) for f in (F.floor, F.ceil))
    part = F.max(place - F.floor(place))
    return (1 - part) * low + part * high


def box(results: DataFrame, metric: str, size: str = "n_nodes") -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges, of each size; exact, whatever a size's number of results."""
    kept = results.where(F.col(size).isNotNull() & F.col(metric).isNotNull()).select(size, F.col(metric).alias("x"))
    counts = written(running_counts(kept, size, "x"), "counts")
    q = counts.groupBy(size).agg(*(quantile("x", share).alias(name) for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    met = counts.join(q, size).groupBy(size, "q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= F.col("q1") - reach, F.col("x"))).alias("low"), F.max(F.when(F.col("x") <= F.col("q3") + reach, F.col("x"))).alias("high"), F.sum("n").alias("n"))
    low, high = F.least("low", "q1"), F.greatest("high", "q3")
    r = lambda c, n: N.rounded(c, 6).alias(n)
    return met.select(size, "n", r(F.col("q1"), "q1"), r(F.col("median"), "median"), r(F.col("q3"), "q3"), r(low, "low"), r(high, "high"))
