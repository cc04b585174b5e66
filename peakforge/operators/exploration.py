"""Analytics over spectra and results."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import global_rank


def coverage(df: DataFrame, columns: list[str], sizes: Column | None = None, few: int = 3, many: int = 500) -> DataFrame:
    """One row: rows, and per column the known and the distinct values; with ``sizes`` also how many are small or large."""
    out = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        out += [F.count(c).alias(f"n_{c}"), F.countDistinct(c).alias(f"distinct_{c}")]
    if sizes is not None:
        out += [F.count_if(sizes < few).alias("n_few_peaks"), F.count_if(sizes > many).alias("n_many_peaks")]
    return df.agg(*out)


def precision_recall(results: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, hits, right, total, precision, recall): hits score above the threshold; a total includes rows without score."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = results.select(grid.alias("threshold"), "score", "exact").groupBy("threshold")
    hit = F.coalesce(F.col("score") > F.col("threshold"), F.lit(False))
    out = rows.agg(F.count_if(hit).alias("hits"), F.count_if(hit & F.col("exact")).alias("right"), F.count(F.lit(1)).alias("total"))
    return out.withColumns({"precision": F.try_divide("right", "hits"), "recall": F.col("hits") / F.col("total")})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row with columns q0, q1, ... Nulls don't count; null if no row does.

    Positions come from a range partitioning, so that no task holds all values.
    """
    ranked = global_rank(df.filter(F.col(column).isNotNull()).select(column), column)
    n = ranked.count()
    out = []
    for i, q in enumerate(at):
        place = (n - 1) * q
        low = math.floor(place)
        a, b = (F.max(F.when(F.col("rank") == min(low + d, n - 1) + 1, F.col(column))) for d in (0, 1))
        out.append(((F.lit(low + 1.0) - place) * a + (F.lit(place) - low) * b).alias(f"q{i}"))
    return ranked.agg(*out)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("all"))
    return row.select(F.inline("all"))


def weighted_neighbourhood(df: DataFrame, by: list[str], score: str, tanimoto: str, power: int, count: str | None = None) -> DataFrame:
    """Sum(s * t^p) / Sum(t^p) per group, each term also times a count if given."""
    w = F.pow(F.col(tanimoto), F.lit(power)) * (F.col(count) if count else F.lit(1))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(score) * w), F.sum(w)).alias("weighted"))


def analog_or_exact(results: DataFrame, difference: Column, minimum: float, limit: float = 0.1) -> DataFrame:
    """One row (n_exact, n_analog): rows above ``minimum`` by whether the mass difference is below ``limit``."""
    hit = F.col("score") > minimum
    return results.agg(F.count_if(hit & (difference < limit)).alias("n_exact"), F.count_if(hit & (difference >= limit)).alias("n_analog"))


def mean_above(results: DataFrame, value: str, thresholds: list[float], condition: Column) -> DataFrame:
    """(threshold, n, mean) of rows that satisfy the condition and score above each threshold."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = results.filter(condition).select(grid, "score", value).filter(F.col("score") > F.col("threshold"))
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def share_above(results: DataFrame, minimum: float, by: str = "query_id", group: str = "fold") -> DataFrame:
    """(group, n, n_above): queries, and those whose best score is above ``minimum``."""
    best = results.groupBy(group, by).agg(F.max("score").alias("best"))
    return best.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("best") > minimum).alias("n_above"))


def with_several(df: DataFrame, key: str) -> DataFrame:
    """Keys with two rows or more: (key, n)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def preselection_sweep(candidates: DataFrame, sizes: list[int], value: str, prediction: str, query: str = "query_id") -> DataFrame:
    """(k, mean): mean over queries of ``value`` at the best prediction among the first k candidates, for every k.

    A running maximum along the rank gives every prefix its best; the grid of sizes then takes one row per query.
    """
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(prediction).alias("p"), (-F.col("rank")).alias("r"), F.col(value).alias("v"))).over(w)
    spans = candidates.withColumns({"best": best, "next": F.coalesce(F.lead("rank").over(Window.partitionBy(query).orderBy("rank")), F.lit(1 << 30))})
    sizes_of = F.filter(F.array(*[F.lit(k).cast("long") for k in sizes]), lambda k: (k >= F.col("rank")) & (k < F.col("next")))
    return spans.select(F.explode(sizes_of).alias("k"), F.col("best.v").alias("v")).groupBy("k").agg(F.avg("v").alias("mean"))


def cumulative_sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n, position, cumulative): group sizes in falling order, ties by key, with their running sum.

    Group sizes are first summed per size: the running sum of earlier sizes comes from one row per distinct size.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(sizes, F.desc("n"), key, column="position")
    per_size = ranked.groupBy("n").agg(F.min("position").alias("first"), F.sum("n").alias("total"))
    per_size = per_size.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranked.join(per_size.select("n", "first", "before"), "n")
    return out.select(key, "n", "position", (F.col("before") + F.col("n") * (F.col("position") - F.col("first") + 1)).cast("long").alias("cumulative"))


def recall_grid(results: DataFrame, value: str, steps: int, top: float) -> DataFrame:
    """(step, cut, n, total, mean) at cuts top / steps * i: how many score above, and the mean of ``value`` over them."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    cuts = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.cast("long").alias("step"), (F.lit(top) / steps * i).alias("cut"))), lambda c: F.col("score") > c["cut"]))
    hits = results.select(cuts.alias("c"), value).groupBy("c.step", "c.cut").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return hits.join(F.broadcast(total))


def first_of_block(df: DataFrame, block: Column, order: list[str], k: int) -> DataFrame:
    """The first k rows of each block."""
    w = Window.partitionBy("__block").orderBy(*order)
    return df.withColumn("__block", block).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).drop("__block")


def large_or_largest(df: DataFrame, key: str, size: str, row_id: str, least: int = 10) -> DataFrame:
    """Per key all rows of at least ``least``, or if there is none the largest row (ties by id)."""
    best = df.groupBy(key).agg(F.max(size).alias("__most"), F.max(F.struct(F.col(size).alias("s"), (-F.col(row_id)).alias("i"))).alias("__top"))
    out = df.join(best, key)
    return out.filter((F.col(size) >= least) | (F.col("__most") < least) & (-F.col(row_id) == F.col("__top.i"))).drop("__most", "__top")


def disjoint(*keys: DataFrame) -> bool:
    """Whether no key is in two of the frames (one column each)."""
    sets = [k.toDF("k").distinct().withColumn("n", F.lit(1)) for k in keys]
    return reduce(DataFrame.unionAll, sets).groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty()
