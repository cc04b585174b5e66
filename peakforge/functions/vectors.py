"""Cosine similarity: as a column expression, and blocked over whole query sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.util import stable

#: Bytes of query vectors that one scan of the library meets, and the queries that are multiplied at once.
QUERY_BYTES = 32 << 20
QUERY_BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def packed(df: DataFrame, dims: list[str], column: str = "embedding") -> DataFrame:
    """One array column in place of one column per dimension."""
    return df.select(*[c for c in df.columns if c not in dims], F.array(*[F.col(f"`{d}`").cast("float") for d in dims]).alias(column))


def _chunks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of queries, QUERY_BYTES at a time; the driver holds two such chunks. Null vectors are NaN."""
    ids, rows, held = [], [], 0

    def chunk() -> tuple[np.ndarray, np.ndarray]:
        dim = max((len(r) for r in rows if r is not None), default=0)
        whole = [r if r is not None else [np.nan] * dim for r in rows]
        return np.array(ids, np.int64), _unit(np.array(whole, float).reshape(len(rows), dim))

    for r in queries.select(query_id, vector).toLocalIterator(prefetchPartitions=False):
        ids.append(r[0])
        rows.append(r[1])
        held += 8 * len(r[1] or ())
        if held >= QUERY_BYTES:
            yield chunk()
            ids, rows, held = [], [], 0
    if ids:
        yield chunk()


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a column of arrays; a null vector, or one of another dimension, is NaN."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    fits = (sizes == dim) & ~column.is_null().to_numpy(zero_copy_only=False)
    out = np.full((len(column), dim), np.nan)
    if fits.any() and dim:
        out[fits] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return _unit(out)


def local_best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of each query's k best scores, ties by id; missing scores are -inf."""
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        at, take = np.nonzero(s >= least)  # ties with the k-th too
    else:
        at, take = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((ids[take], -s[at, take], at))
    at, take = at[order], take[order]
    first = np.searchsorted(at, np.arange(len(s)))
    keep = np.arange(len(at)) - first[at] < k
    return at[keep], take[keep]


def _scored(queries: DataFrame, library: DataFrame, k: int | None, group: str | None, query_id: str, library_id: str, vector: str, carry: tuple[str, ...]) -> DataFrame:
    """One product of queries and library, of which tasks pass on two kinds of rows for each batch: with ``k`` the best k
    of each query (library_id, carry, score), with ``group`` the sum and number of its scores with each group (__group, total, n)."""
    spark = queries.sparkSession
    fields = [f for f in library.select(library_id, *carry).schema]
    kind = library.select(group).schema[0].dataType.simpleString() if group else "string"
    schema = ", ".join([f"`{query_id}` long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double", f"__group {kind}", "total double", "n long"])
    names = [query_id, *[f.name for f in fields], "score", "__group", "total", "n"]
    source = library.select(library_id, *carry, *([F.col(group).alias("__group")] if group else []), vector)
    parts: list[DataFrame] = []
    last: tuple | None = None  # the frame and broadcast of the chunk before

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(batch.num_columns - 1), matrix.shape[1])
                own = batch.column(0).to_numpy(zero_copy_only=False)
                types = [f.type for f in batch.schema][: len(fields)]
                if group:
                    code = batch.column(len(fields)).dictionary_encode()
                    known = code.is_valid().to_numpy(zero_copy_only=False)
                    one = np.zeros((batch.num_rows, len(code.dictionary)))
                    one[np.flatnonzero(known), code.indices.to_numpy(zero_copy_only=False)[known].astype(int)] = 1
                for start in range(0, len(ids), QUERY_BLOCK):
                    some = ids[start : start + QUERY_BLOCK]
                    s = matrix[start : start + QUERY_BLOCK] @ v.T
                    ok = ~np.isnan(s)
                    if k is not None:
                        s = np.where(ok, s, -np.inf)
                        at, take = local_best(s, own, k)
                        score = s[at, take]
                        empty = [pa.nulls(len(at), t) for t in (code.dictionary.type if group else pa.string(), pa.float64(), pa.int64())]
                        best = [batch.column(i).take(pa.array(take)) for i in range(len(fields))]
                        yield pa.RecordBatch.from_arrays([pa.array(some[at]), *best, pa.array(score, mask=np.isinf(score)), *empty], names)
                    if group and len(code.dictionary):
                        total, n = np.where(ok, s, 0) @ one, ok.astype(float) @ one
                        g = pa.array(np.tile(np.arange(one.shape[1]), len(some)))
                        size = len(some) * one.shape[1]
                        empty = [pa.nulls(size, t) for t in (*types, pa.float64())]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, one.shape[1])), *empty, code.dictionary.take(g), pa.array(total.ravel()), pa.array(n.ravel().astype(np.int64))], names)

        return run

    for chunk in _chunks(queries, query_id, vector):
        if last:  # more than one chunk: the earlier ones are computed, so that no broadcast outlives its scan
            parts.append(stable(last[0], "scores"))
            last[1].destroy()
        shared = spark.sparkContext.broadcast(chunk)
        last = (source.mapInArrow(kernel(shared), schema), shared)
    if not last:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, [*parts, last[0]])


def _ranked(rows: DataFrame, k: int, query_id: str, library_id: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), library_id)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _means(rows: DataFrame, query_id: str, group: str) -> DataFrame:
    out = rows.groupBy(query_id, F.col("__group").alias(group)).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return out.select(query_id, group, F.try_divide("total", "n").alias("mean_score"), "n")


def top_k_cosine(queries: DataFrame, library: DataFrame, k: int, query_id: str = "query_id", library_id: str = "spectrum_id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """The k best library rows of each query: (query_id, library_id, carry..., score, rank); ties by library id.

    A chunk of queries is broadcast as a matrix; a task multiplies its batches with it and passes on its local best k of
    each query only. Null and zero vectors, and ones of another dimension, have null scores, ranked last.
    """
    rows = _scored(queries, library, k, None, query_id, library_id, vector, carry)
    return _ranked(rows.drop("__group", "total", "n"), k, query_id, library_id)


def mean_cosine_by_group(queries: DataFrame, library: DataFrame, group: str, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """Mean cosine of each query with all library rows of each group: (query_id, group, mean_score, n).

    Tasks emit one (sum, count) per query, group and batch, which merge exactly; scores themselves are never shuffled.
    """
    known = library.filter(F.col(group).isNotNull()).withColumn("__id", F.lit(0).cast("long"))
    return _means(_scored(queries, known, None, group, query_id, "__id", vector, ()), query_id, group)


def top_k_and_means(queries: DataFrame, library: DataFrame, k: int, group: str, query_id: str = "query_id", library_id: str = "spectrum_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``top_k_cosine`` (with ``group`` carried) and ``mean_cosine_by_group`` from one product, which is computed once."""
    rows = stable(_scored(queries, library, k, group, query_id, library_id, vector, (group,)), "scores")
    best = rows.filter("n is null").drop("__group", "total", "n")
    return _ranked(best, k, query_id, library_id), _means(rows.filter("n is not null and __group is not null"), query_id, group)


def all_cosines(queries: DataFrame, library: DataFrame, query_id: str = "query_id", library_id: str = "spectrum_id", vector: str = "embedding") -> DataFrame:
    """Every query against every library row: (query_id, library_id, score). The result itself is of that size by definition."""
    q = queries.select(query_id, F.col(vector).alias("__q"))
    return q.crossJoin(library.select(library_id, F.col(vector).alias("__v"))).select(query_id, library_id, cosine(F.col("__q"), F.col("__v")).alias("score"))
