"""Queries over the whole tables, against brute force on tables where a cut shows."""

import numpy as np
import pytest

from peakforge.plans import QUERIES

from .compare import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_features_of_every_candidate(spark):
    """sf0.001 has 500 vectors, fewer than the 2000 candidates: each query meets all of them."""
    emb = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").toPandas()["vec_id"]
    expected = {(q, v) for q in emb[emb % 50 == 0] for v in emb}
    got = QUERIES["feature_table"](spark, str(DATA)).select("query_id", "spectrum_id").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_search_reaches_beyond_thirty(spark):
    """Some best match by the model is not among a query's 30 nearest vectors."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    order = {q: ids[np.lexsort((ids, -(v @ v[ids == q][0])))] for q in ids[ids % 50 == 0]}
    found = QUERIES["analog_search"](spark, str(DATA)).select("query_spectrum_nr", "compound_name").collect()
    ranks = [list(order[r[0] - 1]).index(int(r[1].split()[1])) for r in found]
    assert max(ranks) >= 30


def test_every_row_is_searched(spark):
    """Pairs with rows whose id is divisible by 50, the query itself too where self-matches stay."""
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "value").toPandas()
    ids, mz = e["event_id"].to_numpy(), e["value"].to_numpy()
    q = ids % 50 == 0
    near = np.abs(mz[q][:, None] - mz[None, :]) <= 0.25
    expected = {(ids[q][i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)}
    got = [tuple(r) for r in QUERIES["band_join"](spark, str(DATA)).select("query_id", "spectrum_id").collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert all((i, i) in expected for i in ids[q])
    best = QUERIES["best_in_mass_window"](spark, str(DATA)).collect()
    assert {r["query_id"] for r in best} == {a for a, b in expected if a != b} and all(r["query_id"] != r["spectrum_id"] for r in best)


def test_rank_of_truth_beyond_thirty(spark, tmp_path):
    """The only other spectrum of the query's structure is at rank 41; a structure without another has 2001."""
    angle = [0.01 * i for i in range(51)]
    rows = [(i, [float(np.cos(a)), float(np.sin(a))] * 32, 0 if i in (0, 40) else i) for i, a in enumerate(angle)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, 100.0) for i in range(51)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["query_id"]: r["position"] for r in QUERIES["rank_of_truth_position"](spark, str(tmp_path)).collect()}
    assert got == {0: 41, 50: 2001}


def test_sets_of_all_keys_and_items(spark, tmp_path):
    """Keys and items that a fold of either kind would put together: 1 and 26, 5 and 1002."""
    lines = [(1, 5), (1, 7), (1, 7), (26, 1002), (26, 7), (2, 9), (27, 1002)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = {}
    for k, i in lines:
        sets.setdefault(k, set()).add(i)
    expected = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if x & y}
    got = {(r["key_1"], r["key_2"]): r["tanimoto"] for r in QUERIES["tanimoto_sets"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_small_registrations(spark):
    """All vector dimensions, odd query ids too, positions beyond the first thousand."""
    assert QUERIES["document_embedding"](spark, str(DATA)).select("dim").distinct().count() == 64
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "value").toPandas()
    score = e["value"][e["event_id"] % 7 != 0] / 500.0
    got = {r["threshold"]: r["n"] for r in QUERIES["mean_above_threshold"](spark, str(DATA)).collect()}
    assert got == {t: int((score > t).sum()) for t in (0.2, 0.4, 0.6)}
    picked = QUERIES["random_baseline"](spark, str(DATA)).agg({"spectrum_id": "max"}).collect()[0][0]
    assert 1000 <= picked < spark.read.parquet(f"{DATA}/orders.parquet").count()
