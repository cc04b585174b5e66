import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import matching, peaks, sets, vectors
from peakforge.operators.cleaning import normalise_and_filter


def spectrum(mz, intensity):
    return [(float(m), float(i)) for m, i in zip(mz, intensity)]


SPECTRA = "id long, peaks array<struct<mz:double,intensity:double>>"


def test_normalise_golden(spark):
    df = spark.createDataFrame(
        [
            (1, spectrum([5, 110, 220, 330, 399, 440], [10, 10, 1, 10, 20, 100])),
            (2, spectrum([110, 220, 330], [0, 1, 10])),
            (3, spectrum([110, 220], [10, 1])),
            (4, []),
            (5, spectrum([1, 2, 3], [0, 0, 0])),
        ],
        SPECTRA,
    )
    out = {r.id: [p.intensity for p in r.peaks] for r in normalise_and_filter(df).collect()}
    assert out == {1: [0.1, 0.1, 0.01, 0.1, 0.2, 1.0]}


def test_keep_largest_keeps_mz_order(spark):
    df = spark.createDataFrame([(1, spectrum([1, 2, 3, 4], [5, 9, 9, 1]))], SPECTRA)
    assert [p.mz for p in df.select(peaks.keep_largest(F.col("peaks"), 3).alias("p")).first().p] == [1.0, 2.0, 3.0]


def test_words_and_losses(spark):
    df = spark.createDataFrame([(1, spectrum([100.004, 190.0], [1, 2]))], SPECTRA)
    r = df.select(peaks.peak_words(F.col("peaks")).alias("w"), peaks.loss_words(F.col("peaks"), F.lit(200.0)).alias("l")).first()
    assert r.w == ["peak@100.00", "peak@190.00"] and r.l == ["loss@10.00", "loss@100.00"]


def brute_greedy(a, b, tolerance, shift):
    pairs = [(ia * ib, i, j) for (i, (ma, ia)), (j, (mb, ib)) in itertools.product(enumerate(a), enumerate(b)) if abs(ma - mb) <= tolerance or shift and abs(ma - mb - shift) <= tolerance]
    used_a, used_b, score, n = set(), set(), 0.0, 0
    for p, i, j in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            score, n = score + p, n + 1
    norm = (sum(i * i for _, i in a) * sum(i * i for _, i in b)) ** 0.5
    return (score / norm if norm and n else 0.0, n)


@pytest.mark.parametrize("shift", [0.0, 7.0])
def test_greedy_cosine_against_brute_force(shift):
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([(m, rng.random()) for m in sorted(rng.uniform(0, 30) for _ in range(rng.randrange(0, 12)))] for _ in range(2))
        got = matching.greedy_match([m for m, _ in a], [i for _, i in a], [m for m, _ in b], [i for _, i in b], 0.5, shift)
        want = brute_greedy(a, b, 0.5, shift)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def test_cosine_kernels_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(30)] + [(30, 0, [0.0] * 4)]
    lib = spark.createDataFrame(rows, "spectrum_id long, structure int, embedding array<double>")
    q = lib.filter("spectrum_id < 5").select(F.col("spectrum_id").alias("query_id"), "embedding")
    every = {(r.query_id, r.spectrum_id): r.score for r in vectors.all_cosines(q, lib).collect()}
    assert every[0, 30] is None and every[0, 0] == pytest.approx(1)
    top = vectors.top_k_cosine(q, lib, 3).collect()
    for i in range(5):
        want = sorted((s for s in range(30)), key=lambda s: (-every[i, s], s))[:3]
        assert [r.spectrum_id for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == i] == want
    for r in vectors.mean_cosine_by_group(q, lib, "structure").collect():
        own = [every[r.query_id, s] for s in range(30) if s % 3 == r.structure]
        assert r.mean_score == pytest.approx(sum(own) / len(own)) and r.n == len(own)


def test_no_queries(spark):
    lib = spark.createDataFrame([(1, [1.0])], "spectrum_id long, embedding array<double>")
    q = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert vectors.top_k_cosine(q, lib, 3).count() == 0


def test_jaccard_of_sets_and_bits(spark):
    a, b = [0, 5, 63, 64, 200], [5, 64, 100]
    r = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(
        sets.jaccard(F.col("a"), F.col("b")).alias("s"), sets.bit_jaccard(sets.bit_words(F.col("a"), 256), sets.bit_words(F.col("b"), 256), 4).alias("t"), sets.jaccard(F.array(), F.array()).alias("none")
    ).first()
    assert r.s == pytest.approx(2 / 6) and r.t == pytest.approx(2 / 6) and r.none is None


@pytest.mark.parametrize("counted", [5, 1 << 20])
def test_set_pairs_by_blocks(spark, monkeypatch, counted):
    """Several blocks, counts in many and in few steps; repeated rows, nulls and an item that all keys have."""
    monkeypatch.setattr(sets, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(sets, "COUNTED", counted)
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(30)}", rng.randrange(50)) for _ in range(150)] + [(f"k{k}", 99) for k in range(20)] + [("k1", 99), ("k1", None), (None, 99), ("none", None)]
    more = [(k, i) for k in range(12) for i in range(k, 60, 7)]
    own = {}
    other = {}
    for found, part in ((own, rows), (other, more)):
        for k, i in part:
            if k is not None and i is not None:
                found.setdefault(k, set()).add(i)
    one = spark.createDataFrame(rows, "k string, i int")
    two = spark.createDataFrame(more, "k long, i long")
    for got, there in ((sets.jaccard_pairs(one, "k", "i"), own), (sets.jaccard_pairs(one, "k", "i", two), other)):
        want = sorted((a, b, len(x & y), len(x), len(y)) for a, x in own.items() for b, y in there.items() if x & y)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # no pair is shuffled
    assert sets.jaccard_pairs(one.filter("i < 0"), "k", "i").count() == 0
