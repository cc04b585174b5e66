"""The registry of queries, and how the driver's tables stand in for spectra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.util import scratch  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def rounded(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


# --- spectra ---------------------------------------------------------------------------------------------------------


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spectrum_id, peaks): an order's lines, part number as m/z and quantity as intensity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1200).cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    return lines.groupBy(F.col("l_orderkey").alias("spectrum_id")).agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


PEAKS = "pk AS (SELECT l_orderkey AS spectrum_id, (l_partkey % 1200)::DOUBLE AS mz, l_quantity::DOUBLE AS intensity FROM lineitem)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with metadata as it comes from files: the order's total as precursor, its status as ion mode."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("spectrum_id"), F.col("o_totalprice").alias("precursor_mz"), F.col("o_custkey").alias("structure"),
        F.when(F.col("o_orderstatus") == "O", " Positive").when(F.col("o_orderstatus") == "F", "neg").otherwise("n/a").alias("ionmode"),
        F.concat("o_orderpriority", F.lit("; ")).alias("compound_name"),
    )
    return peaks(spark, sf_dir).join(o, "spectrum_id")


def flat(df: DataFrame) -> DataFrame:
    return df.select("spectrum_id", F.inline("peaks"))


# --- library ---------------------------------------------------------------------------------------------------------


def library(spark: SparkSession, sf_dir: str):
    """A library of the embeddings: label as structure, events as metadata, nation and region as classes.

    Structures' fingerprints are their vectors' numbers modulo 97; three neighbours each.
    """
    from ..operators.library import Library
    from ..schema import CLASS_COLUMNS

    emb = table(spark, sf_dir, "embeddings")
    events = table(spark, sf_dir, "events")
    own = emb.select(F.col("vec_id").alias("spectrum_id"), F.col("label").cast("string").alias("inchikey14"), "embedding")
    meta = events.select(F.col("event_id").alias("spectrum_id"), F.col("value").alias("precursor_mz"), F.col("event_type").alias("ionmode"), F.col("user_id").cast("string").alias("retention_time"))
    rows = own.select("spectrum_id", "inchikey14").join(meta, "spectrum_id")
    rows = rows.withColumns({"inchikey": F.concat("inchikey14", F.lit("-"), F.col("spectrum_id").cast("string")), "compound_name": F.concat(F.lit("compound "), F.col("spectrum_id").cast("string")), "smiles": F.when(F.col("spectrum_id") % 2 == 0, F.concat(F.lit("C"), "inchikey14"))})
    bits = emb.select(F.col("label").cast("string").alias("inchikey14"), (F.col("vec_id") * 7 % 97).alias("bit"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").cast("string").alias("inchikey14"), *[F.col("r_name" if i < 2 else "n_name").alias(c) for i, c in enumerate(CLASS_COLUMNS)])
    return Library.build(rows, bits, own.select("spectrum_id", "embedding"), own.select("spectrum_id", F.slice("embedding", 1, 32).alias("embedding")), named, n=3).computed()


def query_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    emb = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.slice("embedding", 1, 32).alias("second_embedding"), F.col("label").cast("string").alias("structure"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("precursor_mz"))
    return emb.join(events, "query_id")


LIBRARY = """emb AS (SELECT vec_id AS spectrum_id, embedding::DOUBLE[] AS v, embedding[1:32]::DOUBLE[] AS w, label::VARCHAR AS st FROM embeddings),
 meta AS (SELECT event_id AS spectrum_id, value AS mz, user_id::VARCHAR AS rt FROM events),
 scores AS (SELECT q.spectrum_id AS query_id, q.st AS query_st, l.spectrum_id, l.st, list_cosine_similarity(q.v, l.v) AS s, list_cosine_similarity(q.w, l.w) AS s2 FROM emb q, emb l WHERE q.spectrum_id % 50 = 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, spectrum_id) AS rk FROM scores),
 means AS (SELECT query_id, st, avg(s) AS m FROM scores GROUP BY query_id, st),
 fp AS (SELECT DISTINCT label::VARCHAR AS st, vec_id * 7 % 97 AS b FROM embeddings),
 sz AS (SELECT st, count(*) AS n FROM fp GROUP BY st),
 tani AS (SELECT p.st, p.nb, p.c / (x.n + y.n - p.c) AS t FROM (SELECT a.st, b.st AS nb, count(*) AS c FROM fp a JOIN fp b ON a.b = b.b GROUP BY a.st, b.st) p JOIN sz x ON x.st = p.st JOIN sz y ON y.st = p.nb),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY t DESC, nb) AS r FROM tani) WHERE r <= 3),
 around AS (SELECT m.query_id, n.st, avg(m.m) AS am, avg(n.t) AS ta FROM near n JOIN means m ON m.st = n.nb GROUP BY m.query_id, n.st),
 feats AS (SELECT k.query_id, k.query_st, k.spectrum_id, k.st, k.s, k.s2, k.rk, a.am, a.ta, l.mz AS mz, q.mz AS qmz, abs(l.mz - q.mz) AS d, l.rt
           FROM ranked k JOIN around a ON a.query_id = k.query_id AND a.st = k.st JOIN meta l ON l.spectrum_id = k.spectrum_id JOIN meta q ON q.spectrum_id = k.query_id WHERE k.rk <= 2000),
 pred AS (SELECT *, am * 0.5 + ta * 0.3 + s2 * 0.2 - least(d / 1000.0, 0.5) AS p FROM feats),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, s DESC, spectrum_id) AS rank FROM pred) WHERE rank <= 3 AND p > 0.2)"""


# --- test results ----------------------------------------------------------------------------------------------------


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, method, query_id, score, k, exact): the events, every seventh without a match. k is the Tanimoto score in percent."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    hit = F.col("event_id") % 7 != 0
    return e.select((F.col("user_id") % 5).alias("fold"), F.col("event_type").alias("method"), F.col("event_id").alias("query_id"),
                    F.when(hit, F.col("value") / 500.0).alias("score"), F.when(hit, k).alias("k"), F.when(hit, k % 2 == 0).alias("exact"))


RESULTS = """res AS (SELECT user_id % 5 AS fold, event_type AS method, event_id AS query_id, CASE WHEN event_id % 7 <> 0 THEN value / 500.0 END AS score,
 CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::BIGINT % 2 = 0 END AS exact FROM events)"""
