"""Evaluation of search results: curves, thresholds, distributions, baselines.

Results are rows (fold, method, query_id, score, tanimoto, exact); a query without a match is a row of nulls, which the
recall's denominator counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.matching import batch_match
from .joins import open_interval
from .util import running


def recall_curve(results: DataFrame, value: str, groups=("fold", "method")) -> DataFrame:
    """Adds rank, total, recall (rank / total * 100) and running: the mean of ``value`` over the best ``rank`` rows."""
    totals = results.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"))
    ranked = running(results.filter(F.col("score").isNotNull()), list(groups), [F.desc("score"), "query_id"], value)
    out = ranked.join(totals, list(groups))
    return out.withColumn("running", F.col("running_sum") / F.col("rank")).withColumn("recall", F.col("rank") * 100.0 / F.col("total")).drop("running_sum")


def binned_curve(curve: DataFrame, bins: int = 1000, groups=("fold", "method")) -> DataFrame:
    """Mean of ``running`` in half-open recall bins (lo, hi] of equal width; an empty bin has 0. Bins are numbered from 0."""
    placed = curve.withColumn("bin", (F.ceil(F.col("rank") * bins / F.col("total")) - 1).cast("long"))
    means = placed.groupBy(*groups, "bin").agg(F.avg("running").alias("mean"))
    grid = curve.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(means, [*groups, "bin"], "left").na.fill(0.0, ["mean"])


def mean_and_deviation(binned: DataFrame, value: str = "mean", by=("method", "bin")) -> DataFrame:
    """Mean and sample standard deviation over folds."""
    return binned.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd_value"))


def threshold_for_recall(results: DataFrame, recall: float, groups=("method",), grid: int = 10_000) -> DataFrame:
    """The least t = k / grid at which at most ``recall`` of all rows score above t: (groups, k, threshold)."""
    totals = results.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("positive"))
    ranked = running(results.filter(F.col("score").isNotNull()), list(groups), [F.desc("score"), "query_id"]).join(totals, list(groups))
    allowed = F.floor(F.col("n") * F.lit(recall))
    next_best = ranked.filter(F.col("rank") == allowed + 1).select(*groups, F.ceil(F.round(F.col("score") * grid, 6)).cast("long").alias("k"))
    out = totals.join(next_best, list(groups), "left")
    k = F.when(F.col("positive") <= allowed, F.lit(0).cast("long")).otherwise(F.col("k"))
    return out.select(*groups, k.alias("k")).withColumn("threshold", F.col("k") / F.lit(float(grid)))


def fixed_histogram(df: DataFrame, value: Column, bins: int = 10, groups=()) -> DataFrame:
    """Counts and percentages in ``bins`` bins of [0, 1]; the last bin holds 1 too. Values outside or null don't count."""
    placed = df.withColumn("__v", value).filter(F.col("__v").between(0, 1)).withColumn("bin", F.least(F.floor(F.col("__v") * bins), F.lit(bins - 1)).cast("long"))
    counts = placed.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*groups)) if groups else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def irregular_histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts in [e0, e1), [e1, e2), ..., the last closed: (bin, n). Bins without rows are absent."""
    at = F.lit(None).cast("long")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        last = i == len(edges) - 2
        at = F.when((value >= lo) & ((value <= hi) if last else (value < hi)), F.lit(i).cast("long")).otherwise(at)
    return df.withColumn("bin", at).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def mass_bin(mass: Column, edges=(0, 300, 600, 5000)) -> Column:
    """Number of the half-open mass range that holds a mass; null outside."""
    out = F.lit(None).cast("long")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((mass >= lo) & (mass < hi), F.lit(i).cast("long")).otherwise(out)
    return out


def distribution_at_recall(results: DataFrame, recall: float, value: Column, bins: int = 10) -> DataFrame:
    """Histogram of ``value`` per method over rows above the method's threshold for one target recall."""
    cut = threshold_for_recall(results, recall)
    above = results.join(cut.select("method", "threshold"), "method").filter(F.col("score") > F.col("threshold"))
    return fixed_histogram(above, value, bins, ("method",))


def match_results(tests: DataFrame, found: DataFrame, tanimoto: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, score, tanimoto, exact) of each test spectrum; all null where nothing was found.

    ``tests``: query, key; ``found``: query, score, key_found; ``tanimoto``: key_1, key_2, tanimoto (absent pairs: 0).
    """
    out = tests.join(found, query, "left").join(tanimoto.toDF("key", "key_found", "tanimoto"), ["key", "key_found"], "left")
    hit = F.col("key_found").isNotNull()
    return out.select(query, "score", F.when(hit, F.coalesce("tanimoto", F.lit(0.0))).alias("tanimoto"), F.when(hit, F.col("key") == F.col("key_found")).alias("exact"))


def optimal_matches(tests: DataFrame, tanimoto: DataFrame, query: str = "query_id") -> DataFrame:
    """The best reachable result: the training structure nearest to each test structure; score is its Tanimoto."""
    w = Window.partitionBy("key_1").orderBy(F.desc("tanimoto"), "key_2")
    best = tanimoto.withColumn("__at", F.row_number().over(w)).filter("__at = 1").select(F.col("key_1").alias("key"), F.col("key_2").alias("best"), "tanimoto")
    return tests.join(best, "key", "left").select(query, F.col("tanimoto").alias("score"), "tanimoto", (F.col("key") == F.col("best")).alias("exact"))


def optimal_other(tanimoto: DataFrame, tests: DataFrame, key: str = "key") -> DataFrame:
    """(key, tanimoto): for each test structure the largest Tanimoto score with a structure that is no test structure itself."""
    others = tanimoto.join(tests.select(F.col(key).alias("key_2")).distinct(), "key_2", "left_anti")
    return others.join(tests.select(F.col(key).alias("key_1")).distinct(), "key_1", "left_semi").groupBy(F.col("key_1").alias(key)).agg(F.max("tanimoto").alias("tanimoto"))


def best_above(pairs: DataFrame, minimum: float, score: str = "score", query: str = "query_id", other: str = "spectrum_id") -> DataFrame:
    """Per query the candidates with a score of ``minimum`` or more, by falling score, and the best of them; queries without any
    are absent: (query, other, score, n_candidates)."""
    good = pairs.filter(F.col(score) >= minimum)
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(other)).alias("o")))
    out = good.groupBy(query).agg(best.alias("b"), F.count(F.lit(1)).alias("n_candidates"))
    return out.select(query, (-F.col("b.o")).alias(other), F.col("b.s").alias(score), "n_candidates")


def best_of_similar_mass(pairs: DataFrame, similarity: Column, minimum: float = 0.8**10, score: str = "score", query: str = "query_id", other: str = "spectrum_id") -> DataFrame:
    """The best row of each query among those whose mass similarity is above ``minimum`` (strictly)."""
    return best_in_mass_window(pairs.filter(similarity > minimum), score, query, other)


def mass_range_distribution(df: DataFrame, mass: str, low: float, high: float, value: Column, bins: int = 10) -> DataFrame:
    """Histogram of ``value`` over rows with low < mass < high: (bin, n, percent)."""
    return fixed_histogram(open_interval(df, mass, low, high), value, bins)


def best_in_mass_window(pairs: DataFrame, score: str = "score", query: str = "query_id", other: str = "spectrum_id") -> DataFrame:
    """The best row of each query, ties by the other id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), other)
    return pairs.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


#: Queries whose peaks one scan of the library meets.
BASELINE_QUERIES = 4096


def peak_baseline(queries: DataFrame, library: DataFrame, mass_tolerance: float = 100.0, kind: str = "greedy", tolerance: float = 0.05, least: int = 0) -> DataFrame:
    """Best library spectrum of each query by greedy or modified cosine within a mass window.

    ``queries``: query_id, precursor_mz, peaks; ``library``: spectrum_id, precursor_mz, peaks. Matches of fewer than
    ``least`` peaks don't count. Queries without a candidate, or without precursor or peaks, give a row of nulls.

    The library is dealt by range of its precursors once. A chunk of queries is broadcast; a task compares each of its
    batches with the queries whose windows reach it and passes on the best of each, so no pair is ever shuffled.
    """
    if kind not in ("greedy", "modified"):
        raise ValueError(f"greedy or modified: {kind!r}")
    spark = queries.sparkSession
    lib = library.filter("precursor_mz is not null").select("spectrum_id", "precursor_mz", F.transform("peaks", lambda p: p["mz"]).alias("mz"), F.transform("peaks", lambda p: p["intensity"]).alias("intensity"))
    lib = lib.repartitionByRange("precursor_mz").sortWithinPartitions("precursor_mz")
    wanted = queries.filter("precursor_mz is not null and peaks is not null").select("query_id", "precursor_mz", "peaks")
    found = [_scan(spark, lib, chunk, mass_tolerance, kind, tolerance, least) for chunk in _query_chunks(wanted)]
    if not found:
        found = [spark.createDataFrame([], "query_id long, spectrum_id long, score double, matches long")]
    best = best_in_mass_window(reduce(DataFrame.unionAll, found))
    return queries.select("query_id").join(best, "query_id", "left")


def _query_chunks(wanted: DataFrame) -> Iterator[list[tuple]]:
    """(precursor, id, peaks' m/z, intensities) of the queries, BASELINE_QUERIES at a time, by precursor."""
    rows = []
    for r in wanted.orderBy("precursor_mz", "query_id").toLocalIterator(prefetchPartitions=False):
        rows.append((r["precursor_mz"], r["query_id"], np.array([p["mz"] for p in r["peaks"]], float), np.array([p["intensity"] for p in r["peaks"]], float)))
        if len(rows) == BASELINE_QUERIES:
            yield rows
            rows = []
    if rows:
        yield rows


def _scan(spark, lib: DataFrame, chunk: list[tuple], window: float, kind: str, tolerance: float, least: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(chunk)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        masses = np.array([q[0] for q in queries])
        for batch in batches:
            ids, mass = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(ids):
                continue
            held = [np.concatenate([np.empty(0), batch.column(i).flatten().to_numpy(zero_copy_only=False)]) for i in (2, 3)]
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(sizes)])
            owner = np.repeat(np.arange(len(ids)), sizes)
            order = np.lexsort((held[0], owner))
            mz, intensity = (h[order] for h in held)
            lo, hi = np.searchsorted(masses, [mass[0] - window * (1 + 1e-9), mass[-1] + window * (1 + 1e-9)])
            rows = []
            for q_mass, q_id, q_mz, q_int in queries[lo : hi + 1]:
                near = np.flatnonzero(np.abs(q_mass - mass) <= window)
                if not len(near):
                    continue
                a, z = near[0], near[-1] + 1  # masses are sorted
                part = slice(at[a], at[z])
                shift = q_mass - mass[a:z] if kind == "modified" else None
                score, matches = batch_match((q_mz, q_int), mz[part], intensity[part], owner[part] - a, z - a, tolerance, shift)
                ok = np.flatnonzero(matches >= least)
                if len(ok):
                    x = ok[np.lexsort((ids[a:z][ok], -score[ok]))[0]]
                    rows.append((q_id, int(ids[a + x]), float(score[x]), int(matches[x])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["query_id", "spectrum_id", "score", "matches"])

    return lib.mapInArrow(best, "query_id long, spectrum_id long, score double, matches long")


def rank_of_truth(candidates: DataFrame, truth: Column, missing: int = 2001, query: str = "query_id") -> DataFrame:
    """Rank of the first candidate that is right, ``missing`` if none is."""
    return candidates.groupBy(query).agg(F.coalesce(F.min(F.when(truth, F.col("rank"))), F.lit(missing)).cast("long").alias("position"))
