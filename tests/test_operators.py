import pytest
from pyspark.sql import functions as F

from peakforge.config import SearchSettings, TrainingSettings
from peakforge.operators import cleaning as C
from peakforge.operators import evaluation as E
from peakforge.operators import joins as J
from peakforge.operators import splits as T
from peakforge.operators.library import Library, representative
from peakforge.operators.search import neighbourhood_scores, rank_results
from peakforge.operators.util import global_rank
from peakforge.schema import CLASS_COLUMNS, output_columns


def test_settings():
    assert SearchSettings(metadata_columns=("A",)).metadata_columns == ("a",)
    with pytest.raises(ValueError):
        SearchSettings(filter_on_ion_mode="both")
    with pytest.raises(ValueError):
        TrainingSettings.of(nonsense=1)


def test_output_columns():
    cols = output_columns(("retention_time",), ("second_score",))
    assert cols[0] == "query_spectrum_nr" and cols[8:10] == ["retention_time", "second_score"] and "npc_isglycoside" not in cols and len(cols) == 18
    assert len(output_columns(classes=False)) == 8


def test_preselection_golden(spark):
    df = spark.createDataFrame([("A", 0.2), ("B", 0.7), ("C", 0.99), ("D", 0.4)], "spectrum_id string, prediction double").withColumns({"query_id": F.lit(1), "embedding_score": F.lit(0.0)})
    assert [r.spectrum_id for r in rank_results(df, 3, 0.0).orderBy("rank").collect()] == ["C", "B", "D"]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.6)], "spectrum_id long, prediction double").withColumns({"query_id": F.lit(1), "embedding_score": F.lit(0.0)})
    assert [r.spectrum_id for r in rank_results(df, 5, 0.5).collect()] == [2]


def test_neighbour_mean_golden(spark):
    values = [0.8] * 5 + [0.7] * 2 + [0.6] * 3
    means = spark.createDataFrame([(1, f"k{i}", v) for i, v in enumerate(values)], "query_id long, inchikey14 string, mean_score double")
    near = spark.createDataFrame([("x", f"k{i}", 1.0) for i in range(10)], "inchikey14 string, neighbour string, tanimoto double")
    wanted = spark.createDataFrame([(1, "x")], "query_id long, inchikey14 string")
    assert neighbourhood_scores(means, near, wanted).first().average_embedding_score == pytest.approx(0.72)


def test_representative_takes_first_of_equals(spark):
    df = spark.createDataFrame([("a", "y", 0), ("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "z", 4)], "k string, v string, i long")
    assert sorted(map(tuple, representative(df, "k", "v", "i").collect())) == [("a", "y", 0), ("b", "z", 4)]


def test_ion_modes(spark):
    df = spark.createDataFrame([(1, "positive"), (2, "negative"), (3, None)], "spectrum_id long, ionmode string")
    assert [r[0] for r in C.keep_ion_mode(df, "positive").collect()] == [1]
    assert sorted(r[0] for r in C.keep_ion_mode(df, "positive", nulls=True).collect()) == [1, 3]
    assert C.probe_ion_mode(df.filter("spectrum_id > 2")).first().ionmode is None
    assert C.check_ion_mode(df, None).count() == 3
    with pytest.raises(Exception, match="negative"):
        C.check_ion_mode(df, "positive").collect()
    with pytest.raises(ValueError):
        C.keep_ion_mode(df, "neutral")


def test_lookup_requires_every_key(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(1, "x")], "id long, v string")
    assert J.lookup_join(a, b, "id", required=False).count() == 2
    with pytest.raises(Exception, match="not in the table"):
        J.lookup_join(a, b, "id").collect()


def test_band_join_ends_and_left(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, None)], "q long, x double")
    b = spark.createDataFrame([(7, 9.5), (8, 10.5), (9, 10.6)], "l long, y double")
    assert sorted((r.q, r.l) for r in J.band_join(a, b, "x", "y", 0.5).collect()) == [(1, 7), (1, 8)]
    left = {(r.q, r.l) for r in J.band_join(a.filter("x is not null"), b, "x", "y", 0.5, "left").collect()}
    assert left == {(1, 7), (1, 8), (2, None)}


@pytest.mark.parametrize("n,k", [(61, 10), (5, 10), (20, 4)])
def test_k_sets_partition_the_keys(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("key"))
    out = T.k_sets(df, "key", k).collect()
    sizes = [sum(r.set_no == i for r in out) for i in range(k)]
    assert len({r.key for r in out}) == n == sum(sizes) and max(sizes) - min(sizes) <= 1


def test_holdouts(spark):
    df = spark.range(61).select(F.col("id").alias("key"))
    assert T.holdout_structures(df, "key", 10).filter("held_out").count() == 6
    assert T.holdout_structures(df, "key", 100).filter("held_out").count() == 0
    assert T.holdout_rows(df, "key", 10).filter("held_out").count() == 7


def test_global_rank_is_dense(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7919 % 1000).repartition(7)
    assert all(r["rank"] == r.x + 1 for r in global_rank(df, "x").collect())


def test_null_results_stay_in_the_recall(spark):
    rows = [(0, "m", 1, 0.9, 80), (0, "m", 2, 0.5, 40), (0, "m", 3, None, None), (0, "m", 4, None, None)]
    curve = E.recall_curve(spark.createDataFrame(rows, "fold int, method string, query_id long, score double, k long"), "k").orderBy("rank").collect()
    assert [(r.recall, r.running) for r in curve] == [(25.0, 80.0), (50.0, 60.0)]
    binned = {r.bin: r.mean for r in E.binned_curve(E.recall_curve(spark.createDataFrame(rows, "fold int, method string, query_id long, score double, k long"), "k"), 4).collect()}
    assert binned == {0: 80.0, 1: 60.0, 2: 0.0, 3: 0.0}


def test_peak_baseline(spark):
    schema = "{} long, precursor_mz double, peaks array<struct<mz:double,intensity:double>>"
    own = [(100.0, 1.0), (200.0, 2.0), (300.0, 3.0)]
    q = spark.createDataFrame([(1, 500.0, own), (2, 9000.0, own)], schema.format("query_id"))
    lib = spark.createDataFrame([(7, 510.0, own), (8, 500.0, [(50.0, 1.0)])], schema.format("spectrum_id"))
    for kind in ("greedy", "modified"):
        out = {r.query_id: r for r in E.peak_baseline(q, lib, 100, kind).collect()}
        assert out[1].spectrum_id == 7 and out[1].score == pytest.approx(1) and out[2].spectrum_id is None
    with pytest.raises(ValueError):
        E.peak_baseline(q, lib, 100, "other")


def test_library_round_trip(spark, tmp_path):
    spectra = spark.createDataFrame([(i, 100.0 + i, "positive", f"KEY{i % 3}") for i in range(9)], "spectrum_id long, precursor_mz double, ionmode string, inchikey14 string")
    bits = spark.createDataFrame([(f"KEY{k}", b) for k in range(3) for b in range(k + 3)], "inchikey14 string, bit long")
    emb = spectra.select("spectrum_id", F.array(F.col("spectrum_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    lib = Library.build(spectra, bits, emb, emb, n=2)
    lib.save(f"{tmp_path}/lib")
    back = Library.open(spark, f"{tmp_path}/lib")
    s = {r.inchikey14: r for r in back.structures.collect()}
    assert s["KEY0"].spectrum_ids == [0, 3, 6] and s["KEY0"].neighbours[0].inchikey14 == "KEY0" and not back.has_classes()
    with pytest.raises(Exception):
        lib.save(f"{tmp_path}/lib")
    with pytest.raises(ValueError):
        Library(spectra, lib.structures, emb.limit(3), emb).check()
    assert len(CLASS_COLUMNS) == 9


def test_nearest_fingerprints_against_all_pairs(spark, monkeypatch):
    import random

    from peakforge.functions import sets as S

    monkeypatch.setattr(S, "CHUNK_ROWS", 5)
    rng = random.Random(1)
    prints = {f"k{i}": {rng.randrange(150) for _ in range(rng.randrange(1, 40))} for i in range(40)}
    rows = spark.createDataFrame([(k, b) for k, bits in prints.items() for b in bits], "key string, bit long")
    words = S.fingerprint_words(rows, "key", "bit").repartition(3)
    for size in (16 << 20, 100):
        monkeypatch.setattr(S, "CHUNK_BYTES", size)
        got = sorted((r.key_1, r["rank"], r.key_2, r.tanimoto) for r in S.nearest_by_bits(words, words, 4).collect())
        want = []
        for a, x in prints.items():
            best = sorted((-len(x & y) / len(x | y), b) for b, y in prints.items() if x & y)[:4]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
        assert got == sorted(want)


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from peakforge.operators.util import running

    rows = [("a" if i % 3 else None, i, (i * 7919) % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, x long").repartition(5)
    got = {r.id: (r["rank"], r.running_sum) for r in running(df, ["g"], [F.desc("x"), "id"], "x").collect()}
    for g in ("a", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 0
        for k, (_, i, x) in enumerate(own, 1):
            total += x
            assert got[i] == (k, total)


def test_ion_modes_are_counted_and_asserted(spark):
    from pyspark.sql import Observation

    from peakforge.operators import cleaning as C

    df = spark.createDataFrame([(1, "positive"), (2, "negative"), (3, None)], "spectrum_id long, ionmode string")
    report = Observation()
    assert [r.spectrum_id for r in C.keep_ion_mode(df, "positive", report=report).collect()] == [1]
    assert report.get == {"kept": 1, "removed": 2}
    assert C.check_ion_mode(df.filter("spectrum_id <> 2"), "positive").count() == 2
    with pytest.raises(Exception, match="a query of negative"):
        C.check_ion_mode(df, "positive").collect()
