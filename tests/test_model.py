"""Training, scoring, export and embedding of models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.config import TrainingSettings
from peakforge.operators import evaluation as E
from peakforge.operators import model as M
from peakforge.operators import onnx_export as X
from peakforge.operators import suites
from peakforge.operators.library import Library, tanimoto_pairs
from peakforge.operators.search import FEATURES, linear_score
from peakforge.sources import loader, sinks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 5)).astype(np.float32)
    y = np.where(x[:, 3] > 0.5, 0.8, 0.2) + 0.1 * x[:, 4]
    return spark.createDataFrame([(int(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], ["id", *FEATURES, "tanimoto"]).cache()


@pytest.fixture(scope="module")
def forest(data):
    return M.train_forest(data, settings=TrainingSettings.of(n_trees=20, min_leaf=5))


def test_forest_learns(data, forest):
    scored = M.forest_scorer(forest)(data)
    assert M.mean_squared_error(scored, "tanimoto").first().mse < 0.01
    assert M.feature_importances(forest)[0][0] == FEATURES[3]


def test_forest_saved_and_loaded(data, forest, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel

    M.save_model(forest, str(tmp_path / "m"))
    again = RandomForestRegressionModel.load(str(tmp_path / "m"))
    key = lambda m: [r.prediction for r in M.forest_scorer(m)(data).orderBy("id").collect()]
    assert key(again) == key(forest)


def test_exported_forest_scores_alike(data, forest, tmp_path):
    path = str(tmp_path / "f.onnx")
    X.export_forest(forest, path, len(FEATURES))
    one = M.forest_scorer(forest)(data).select("id", F.col("prediction").alias("p"))
    two = M.onnx_scorer(path)(data).select("id", "prediction")
    rows = one.join(two, "id").collect()
    assert len(rows) == 400 and max(abs(r.p - r.prediction) for r in rows) < 1e-5
    with pytest.raises(FileExistsError):
        X.export_forest(forest, path, len(FEATURES))
    for f in (lambda: X.export_forest(forest, "x.pickle", 5), lambda: M.onnx_scorer("x.pickle")):
        with pytest.raises(ValueError):
            f()


def test_thresholds_go_to_the_float_below():
    for x in (0.1, -0.1, 1e-3, 0.5, 0.0, 123456.789):
        f = X.float_below(x)
        assert f <= x < float(np.nextafter(np.float32(f), np.float32(np.inf)))


def test_embedding_by_a_network(spark, tmp_path):
    s = TrainingSettings.of(mz_min=0.0, mz_max=3.0, mz_bin_width=1.0)
    weights = np.arange(6, dtype=np.float32).reshape(3, 2)
    (tmp_path / "n.onnx").write_bytes(X.model_bytes([X.node("MatMul", ["input", "w"], ["variable"])], 3, 2, [X.tensor("w", (3, 2), weights.ravel().tolist())]))
    rows = [(1, [(0.5, 4.0), (2.5, 9.0), (2.6, 1.0), (7.0, 5.0)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id long, peaks array<struct<mz:double,intensity:double>>")
    out = {r.id: r.embedding for r in M.onnx_embedder(str(tmp_path / "n.onnx"), s)(df).collect()}
    assert out == {1: [12.0, 17.0], 2: [0.0, 0.0], 3: None}


def test_document_embedding_against_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = {f"w{i}": rng.random(7) for i in range(20)}
    docs = [(f"d{i}", [f"w{rng.integers(25)}" for _ in range(rng.integers(0, 9))]) for i in range(60)]
    docs = [(k, w, rng.random(len(w)).tolist()) for k, w in docs]
    df = spark.createDataFrame(docs, "k string, words array<string>, weights array<double>").repartition(3)
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "word string, vector array<double>")
    got = {r.k: r.embedding for r in M.document_embedding(df, table, "k").collect()}
    want = {k: sum(x * vectors[y] for y, x in zip(w, v, strict=True) if y in vectors) for k, w, v in docs if any(y in vectors for y in w)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(list(want[k])) for k in want)


def test_word_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 20, "words array<string>")
    out = M.train_word_vectors(df, dim=4, iterations=1).collect()
    assert sorted(r.word for r in out) == ["a", "b", "c"] and all(len(r.vector) == 4 for r in out)


@pytest.fixture(scope="module")
def library(spark):
    rows = [(i, 100.0 + 50 * (i % 3) + i / 100, "positive", f"K{i % 3}") for i in range(30)]
    spectra = spark.createDataFrame(rows, "spectrum_id long, precursor_mz double, ionmode string, inchikey14 string")
    bits = spark.createDataFrame([(f"K{k}", b) for k in range(3) for b in range(k + 2)], "inchikey14 string, bit long")
    vector = F.array(*[F.when(F.col("spectrum_id") % 3 == k, 1.0 + F.col("spectrum_id") / 100).otherwise(0.1).cast("float") for k in range(3)])
    emb = spectra.select("spectrum_id", vector.alias("embedding"))
    queries = spectra.filter("spectrum_id < 6").join(emb, "spectrum_id").withColumn("second_embedding", F.col("embedding")).withColumnRenamed("spectrum_id", "query_id")
    return Library.build(spectra, bits, emb, emb, n=2), queries, tanimoto_pairs(bits, "inchikey14", "bit")


def test_training_data(library):
    lib, queries, tanimoto = library
    rows = M.training_data(queries, lib, tanimoto, k=5).collect()
    labels = {(r.key_1, r.key_2): r.tanimoto for r in tanimoto.collect()}
    keys = {r.query_id: r.inchikey14 for r in queries.collect()}
    assert len(rows) == 30 and all(r.tanimoto == labels[keys[r.query_id], r.inchikey14] for r in rows)
    assert all(r[c] is not None for r in rows for c in FEATURES)


def test_one_fold(spark, library, tmp_path):
    lib, queries, tanimoto = library
    suites.run_fold(lib, queries, queries, tanimoto, str(tmp_path / "s"), 3, False, TrainingSettings.of(n_trees=3, min_leaf=1, candidates_per_query=10))
    stored = suites.load_suites(spark, str(tmp_path / "s"))
    got = {r.method: r["count"] for r in stored.filter("fold = 3").groupBy("method").count().collect()}
    assert got == {m: 6 for m in ("search", "embedding_all", "embedding_window", "random", "optimal")}
    assert stored.filter("method = 'search' and score is not null").count() == 6


def test_clean_and_store(spark, tmp_path):
    rows = [(1, [(10.0, 1.0), (20.0, 1.0), (30.0, 1.0)], 300.0, "positive", "C", "InChI=1S/CH4", "VNWKTOKETHGBQD-UHFFFAOYSA-N"), (2, [(10.0, 1.0), (20.0, 1.0), (30.0, 1.0)], 300.0, "positive", None, None, None), (3, [(10.0, 1.0)], 300.0, "positive", None, None, None)]
    df = spark.createDataFrame(rows, "spectrum_id long, peaks array<struct<mz:double,intensity:double>>, precursor_mz double, ionmode string, smiles string, inchi string, inchikey string").withColumn("compound_name", F.lit("x"))
    suites.clean_and_store(df, "positive", str(tmp_path / "c"))
    got = [sorted(r.spectrum_id for r in spark.read.parquet(str(tmp_path / "c" / n)).collect()) for n in ("annotated", "unannotated")]
    assert got == [[1], [2]]


def test_results_and_classes_from_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.7, 5.5, "x")], "query_spectrum_nr long, rank long, model_prediction double, precursor_mz_difference double, name string")
    sinks.write_results(df, str(tmp_path / "r.csv"), single=True)
    back = loader.read_results(spark, str(tmp_path / "r.csv"))
    assert dict(back.dtypes)["model_prediction"] == "double" and tuple(back.first()) == (1, 0.7, 5.5, "x")
    sinks.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_parquet(df, str(tmp_path / "p"))
    sinks.write_classes(spark.createDataFrame([("K", "a\tb")], "inchikey string, cf_kingdom string"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).first().inchikey == "K"
    assert spark.range(1).select(sinks.file_name(F.lit("file:/a/b c.mgf")).alias("n")).first().n == "b c.mgf"


def test_library_is_not_half_written(spark, library, tmp_path):
    lib, _, _ = library
    lib.embeddings.write.parquet(str(tmp_path / "l" / "second_embeddings"))
    with pytest.raises(FileExistsError):
        lib.save(str(tmp_path / "l"))
    assert [p.name for p in (tmp_path / "l").iterdir()] == ["second_embeddings"]


def test_null_vectors_and_several_chunks(spark, monkeypatch):
    from peakforge.functions import vectors as V

    rng = np.random.default_rng(3)
    lib = [(i, f"g{i % 3}" if i % 4 else None, rng.integers(0, 3, 4).astype(float).tolist() if i % 5 else None) for i in range(60)]
    lib += [(60, "g0", [0.0] * 4), (61, "g0", [1.0, 2.0])]
    queries = [(i, v) for i, _, v in lib[:30]]
    a = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    b = spark.createDataFrame(lib, "spectrum_id long, g string, embedding array<double>").repartition(3)

    def cosine(x, y):
        if x is None or y is None or len(x) != len(y):
            return None
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return float(np.dot(x, y) / n) if n else None

    scores = {q: sorted(((-s if s is not None else 9.0, i) for i, _, v in lib for s in [cosine(x, v)]))[:7] for q, x in queries}
    for size in (32 << 20, 200):
        monkeypatch.setattr(V, "QUERY_BYTES", size)
        best, means = V.top_k_and_means(a, b, 7, "g")
        got = {}
        for r in best.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.spectrum_id, r.score))
        for q, x in queries:
            assert [s for _, s in got[q]] == pytest.approx([None if s == 9.0 else -s for s, _ in scores[q]], nan_ok=True)
        mean = {(r.query_id, r.g): (r.mean_score, r.n) for r in means.collect()}
        for q, x in queries:
            for g in ("g0", "g1", "g2"):
                own = [s for i, h, v in lib if h == g for s in [cosine(x, v)] if s is not None]
                assert mean[q, g][1] == len(own) and (mean[q, g][0] == pytest.approx(np.mean(own)) if own else mean[q, g][0] is None)


def test_batch_matching_equals_one_by_one():
    from peakforge.functions.matching import batch_match, greedy_match

    rng = np.random.default_rng(4)
    for _ in range(100):
        q = np.sort(rng.integers(0, 40, 12) / 10), rng.integers(1, 4, 12).astype(float)
        lib = [(np.sort(rng.integers(0, 40, k) / 10), rng.integers(1, 4, k).astype(float)) for k in rng.integers(0, 10, 6)]
        owner = np.repeat(np.arange(6), [len(m) for m, _ in lib])
        mz, inten = np.concatenate([m for m, _ in lib]), np.concatenate([i for _, i in lib])
        for shift in (None, rng.choice([0.0, 0.35, -0.5], 6)):
            score, matches = batch_match(q, mz, inten, owner, 6, 0.1, shift)
            want = [greedy_match(*q, m, i, 0.1, 0.0 if shift is None else shift[k]) for k, (m, i) in enumerate(lib)]
            assert matches.tolist() == [w[1] for w in want] and score == pytest.approx([w[0] for w in want])


@pytest.mark.parametrize("kind", ["greedy", "modified"])
def test_peak_baseline_against_all_pairs(spark, kind, monkeypatch):
    from peakforge.functions.matching import greedy_match

    monkeypatch.setattr(E, "BASELINE_QUERIES", 7)
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(100, 130)) if i % 9 else None, [(float(m), float(x)) for m, x in zip(np.sort(rng.integers(0, 30, 8)), rng.integers(1, 5, 8), strict=True)] if i % 7 else []) for i in range(80)]
    df = spark.createDataFrame(rows, "spectrum_id long, precursor_mz double, peaks array<struct<mz:double,intensity:double>>")
    q = df.filter("spectrum_id % 4 = 0").withColumnRenamed("spectrum_id", "query_id")
    got = {r.query_id: (r.spectrum_id, r.score, r.matches) for r in E.peak_baseline(q, df, 3.0, kind, 0.5, 1).collect()}
    split = lambda p: ([m for m, _ in p], [x for _, x in p])
    for i, mass, peaks in rows:
        if i % 4:
            continue
        best = None
        for j, other, theirs in rows:
            if mass is not None and other is not None and abs(mass - other) <= 3.0:
                s, n = greedy_match(*split(peaks), *split(theirs), 0.5, mass - other if kind == "modified" else 0.0)
                if n >= 1 and (best is None or s > best[1] + 1e-12):
                    best = (j, s, n)
        assert got[i] == (pytest.approx(best) if best else (None, None, None))
    assert linear_score is not None


def test_left_band_join_with_null_columns(spark):
    from peakforge.operators.joins import band_join

    left = spark.createDataFrame([(1, 10.0, None), (2, 10.0, "n"), (3, None, None), (4, 99.0, "x"), (4, 99.0, "x")], "id long, a double, note string")
    right = spark.createDataFrame([(7, 10.1)], "r long, b double")
    out = sorted((r.id, r.r) for r in band_join(left, right, "a", "b", 0.25, "left").collect() if r.r) , sorted(r.id for r in band_join(left, right, "a", "b", 0.25, "left").collect() if not r.r)
    assert out == ([(1, 7), (2, 7)], [3, 4, 4])
