"""Hold-outs and folds. Random order is the MD5 of key and seed: equal in every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import global_rank, seeded


def _ranked(df: DataFrame, key: str, seed) -> tuple[DataFrame, int]:
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__h", seeded(F.col(key), seed))
    ranked = global_rank(keys, "__h", key, column="rank").drop("__h")
    return ranked, ranked.count()


def holdout_structures(df: DataFrame, key: str, fraction: int, seed=42) -> DataFrame:
    """Add held_out: whether the row's key is among the last n // fraction of all n keys in random order."""
    ranked, n = _ranked(df, key, seed)
    held = ranked.filter(F.col("rank") > n - n // fraction).select(key).withColumn("held_out", F.lit(True))
    return df.join(held, key, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def holdout_rows(df: DataFrame, row_id: str, fraction: int = 10, seed=42) -> DataFrame:
    """Add held_out for the last ceil(n / fraction) rows in random order of their id."""
    ranked = global_rank(df.withColumn("__h", seeded(F.col(row_id), seed)), "__h", row_id, column="__rank")
    n = ranked.count()
    return ranked.withColumn("held_out", F.col("__rank") > n - -(-n // fraction)).drop("__h", "__rank")


def k_sets(df: DataFrame, key: str, k: int, seed=42) -> DataFrame:
    """(key, set_no): k disjoint sets of n // k keys in random order, the rest dealt one by one to sets 0, 1, ..."""
    ranked, n = _ranked(df, key, seed)
    size = n // k
    at = F.col("rank") - 1
    in_set = F.when(at < k * size, F.floor(at / F.lit(max(size, 1)))).otherwise(at - k * size).cast("long")
    return ranked.select(key, in_set.alias("set_no"))


def analogue_folds(df: DataFrame, key: str, k: int, seed=42) -> DataFrame:
    """Every row in every fold: (columns..., fold, is_test); fold i tests on set i and trains on the others."""
    sets = k_sets(df, key, k, seed)
    return df.join(sets, key).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_test", F.col("fold") == F.col("set_no")).withColumn("fold", F.col("fold").cast("long")).drop("set_no")


def exact_folds(df: DataFrame, key: str, row_id: str, k: int, seed=42) -> DataFrame:
    """Every row in every fold: one random row of each key with two rows or more is a test row. Folds are independent."""
    folds = df.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    order = F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed)), F.col("fold").cast("string")))
    own = folds.groupBy("fold", key).agg(F.min(F.struct(order.alias("h"), F.col(row_id).alias("id"))).alias("first"), F.count(F.lit(1)).alias("n"))
    picked = own.filter("n > 1").select("fold", key, F.col("first.id").alias("__test"))
    return folds.join(picked, ["fold", key], "left").withColumn("is_test", F.coalesce(F.col(row_id) == F.col("__test"), F.lit(False))).drop("__test")


def random_pick(queries: DataFrame, n_library: int, query: str = "query_id", seed=42) -> DataFrame:
    """A random library position and score for each query."""
    h = lambda s: F.conv(F.substring(seeded(F.col(query), s), 1, 8), 16, 10).cast("long")
    return queries.withColumns({"spectrum_id": F.pmod(h(f"{seed}a"), F.lit(max(n_library, 1))), "score": h(f"{seed}b") / F.lit(float(1 << 32))})


def structure_and_row_holdout(df: DataFrame, key: str, row_id: str, n_structures: int, n_rows: int, seed=42) -> DataFrame:
    """Add part: all rows of the first n_structures random keys are ``structures``; of other keys with two rows or more one
    row of each of the first n_rows random keys is ``rows``; the rest is ``train``."""
    ranked, _ = _ranked(df, key, seed)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(seeded(F.col(row_id), seed).alias("h"), F.col(row_id).alias("id"))).alias("__first"))
    several = counts.join(ranked.filter(F.col("rank") > n_structures), key).filter("__n > 1").select(key, "__first", F.col("rank").alias("__r"))
    rows = global_rank(several, "__r", column="__at").filter(F.col("__at") <= n_rows).select(key, F.col("__first.id").alias("__row"))
    out = df.join(ranked, key, "left").join(rows, key, "left")
    part = F.when(F.col("rank") <= n_structures, "structures").when(F.col(row_id) == F.col("__row"), "rows").otherwise("train")
    return out.withColumn("part", part).drop("rank", "__row")
