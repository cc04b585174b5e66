"""Helpers for exact global ranks and stable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``.

    That is set here only where it is unset and everything runs in one process; on a cluster without it an error is raised.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="peakforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame, name: str = "stable") -> DataFrame:
    """``df``, computed once: written to the shared folder and read again, so that it outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def files_of(spark: SparkSession, folder: str) -> list[str]:
    """Names of the regular files of a folder, sorted, on whatever file system it is; folders in it are not entered."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().getName() for f in found if f.isFile())


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def global_rank(df: DataFrame, *order: Column | str, column: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in a total order, without bringing all rows into one task.

    Rows are dealt by range and sorted within; one count per range gives the offsets.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__rank_at", F.monotonically_increasing_id())
    dealt = stable(dealt.withColumn("__rank_part", F.shiftright("__rank_at", 33)).withColumn("__rank_at", F.col("__rank_at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("__rank_part").count().collect())  # a row per range
    starts = accumulate((n for _, n in counts), initial=0)
    offset = F.create_map(*[F.lit(x) for (part, _), start in zip(counts, starts) for x in (part, start)]) if counts else F.create_map(F.lit(0), F.lit(0))  # noqa: B905
    return dealt.withColumn(column, (offset[F.col("__rank_part")] + F.col("__rank_at") + 1).cast("long")).drop("__rank_part", "__rank_at")


def running(df: DataFrame, groups: list[str], order: list[Column | str], value: str | None = None) -> DataFrame:
    """Add ``rank``, the 1-based position of each row in its group, and with ``value`` ``running_sum`` over the rows up to it.

    Rows are dealt by range of groups and order, so that a large group spreads over tasks; sums per range and group, of which
    there are few, give what lies before each range.
    """
    dealt = stable(df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id()), "running")
    sums = [F.count(F.lit(1)).alias("__n"), *([F.sum(value).alias("__s")] if value else [])]
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*groups, "__part").agg(*sums)
    parts = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__n", "__s")[: 2 if value else 1]])
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*groups, "__part").orderBy(*order)
    out = dealt.join(parts, on).withColumn("rank", (F.col("__n0") + F.row_number().over(within)).cast("long"))
    if value:
        up_to = within.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("running_sum", F.col("__s0") + F.coalesce(F.sum(value).over(up_to), F.lit(0)))
    return out.drop("__part", "__p", "__n0", "__s0", *[f"__g{i}" for i in range(len(groups))])


def seeded(key: Column, seed: str | int) -> Column:
    """MD5 of the key and a seed: a random order that is the same in every run, partitioning and engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
