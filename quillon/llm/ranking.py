"""Problem 1: one ranking out of several scores on unlike scales."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import latest

#: Coefficients of Acklam's rational approximation of the inverse normal distribution function.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

#: Scores per octave into which a group's values are cut for ranking in parallel: 2 ** _MANTISSA.
_MANTISSA = 8


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1 (relative error below 1.2e-9), JVM-side."""
    low = F.least(p, 1 - p)
    tail = F.sqrt(-2 * F.log(low))
    far = _poly(tail, _C) / (_poly(tail, _D) * tail + 1)
    q = p - 0.5
    r = q * q
    near = _poly(r, _A) * q / (_poly(r, _B) * r + 1)
    return F.when(low >= 0.02425, near).when(p < 0.5, far).otherwise(-far)


def _slice(v: Column) -> Column:
    """Order-preserving cell of a double (null lowest): sign, exponent and the first bits of the mantissa."""
    a = F.abs(v)
    e = F.floor(F.log2(F.when(a < 1e-300, F.lit(1e-300)).when(a > 1e300, F.lit(1e300)).otherwise(a)))
    m = F.greatest(F.lit(0), F.least(F.lit((1 << _MANTISSA) - 1), F.floor((a / F.pow(F.lit(2.0), e) - 1) * (1 << _MANTISSA))))
    size = ((e + 1100) * (1 << _MANTISSA) + m).cast("long")
    return F.when(v.isNull(), F.lit(-(1 << 40))).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def rank_scores(items: DataFrame, group: str, key: str, scores: Mapping[str, float]) -> DataFrame:
    """Rank the items of each group by the weighted mean of their normal scores.

    items: distinct (group, key) with one numeric column per name in ``scores``
    (name -> weight). Each score becomes its empirical percentile in the group
    with averaged ties, (rank - 1/2) / n, then the normal quantile of that.

    Returns group, key, n (items of the group), place (mean percentile of the
    item over its scores, weighted), score (weighted mean of the quantiles) and
    position (1 is best; ties by key).

    Null and NaN scores count as the lowest, tied with each other. Null groups
    or keys are left out; an empty table gives no rows; columns that are not
    named are ignored. A group may hold most of all rows: values are counted
    before they are shuffled, ranked in cells of their order (whose bounds are
    fixed) and the cells' counts are summed up.
    """
    total = float(sum(scores.values()))
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    base = items.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    long = base.select(
        F.col(group).alias("g"),
        F.col(key).alias("k"),
        F.posexplode(F.array(*(number(c) for c in scores))).alias("s", "v"),
    ).withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v"))).withColumn("b", _slice(F.col("v")))
    ties = long.groupBy("g", "s", "b", "v").agg(F.count("*").alias("c"))
    before = W.partitionBy("g", "s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        ties.groupBy("g", "s", "b")
        .agg(F.sum("c").alias("cb"))
        .withColumn("under", F.coalesce(F.sum("cb").over(before), F.lit(0)))
        .withColumn("n", F.sum("cb").over(W.partitionBy("g", "s")))
        .drop("cb")
    )
    inside = W.partitionBy("g", "s", "b").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    percent = (
        ties.withColumn("less", F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .join(cells, ["g", "s", "b"])
        .select("g", "s", "v", "n", ((F.col("under") + F.col("less") + F.col("c") / 2) / F.col("n")).alias("p"))
        .withColumn("z", inverse_normal(F.col("p")))
    )
    weight = F.element_at(F.array(*(F.lit(float(w) / total) for w in scores.values())), F.col("s") + 1)
    left, right = long.alias("l"), percent.alias("r")
    scored = (
        left.join(right, (F.col("l.g") == F.col("r.g")) & (F.col("l.s") == F.col("r.s")) & F.col("l.v").eqNullSafe(F.col("r.v")))
        .select("l.g", "l.k", "l.s", "n", "p", "z")
        .groupBy("g", "k")
        .agg(
            F.max("n").alias("n"),
            F.round(F.sum(weight * F.col("p")), 12).alias("place"),
            F.round(F.sum(weight * F.col("z")), 12).alias("score"),
        )
    )
    return scored.select(F.col("g").alias(group), F.col("k").alias(key), "n", "place", "score")


def best_of_groups(ranked: DataFrame, group: str, key: str, by: str = "place", least: int = 1) -> DataFrame:
    """The first item of each group of at least ``least`` items: highest ``by``, then highest score, then smallest key."""
    return (
        ranked.where(F.col("n") >= least)
        .groupBy(group)
        .agg(F.min(F.struct((-F.col(by)).alias("a"), (-F.col("score")).alias("b"), F.col(key).alias("k"))).alias("_m"))
        .select(group, F.col("_m.k").alias(key))
    )


def positions(ranked: DataFrame, group: str, key: str) -> DataFrame:
    """Adds position (1 is best): by score, then key, counted in cells of the score so that no group is one task."""
    cut = ranked.withColumn("b", _slice(F.col("score")))
    above = W.partitionBy(group).orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)
    cells = cut.groupBy(group, "b").agg(F.count("*").alias("c")).withColumn("over", F.coalesce(F.sum("c").over(above), F.lit(0))).drop("c")
    inside = W.partitionBy(group, "b").orderBy(F.col("score").desc(), F.col(key))
    return cut.withColumn("r", F.row_number().over(inside)).join(cells, [group, "b"]).withColumn("position", F.col("over") + F.col("r")).drop("b", "r", "over")


def session_scores(memories: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Each memory (its latest version) with its four scores; centrality is the greatest of its memory nodes."""
    own = latest(memories, "session_id", "importance", "confidence", "access_count")
    nodes = (
        graph_nodes.where((F.col("kind") == "memory") & F.col("memory_id").isNotNull())
        .groupBy(F.col("memory_id"))
        .agg(F.max("centrality").alias("centrality"))
    )
    return own.withColumnRenamed("id", "memory_id").join(nodes, "memory_id", "left")
