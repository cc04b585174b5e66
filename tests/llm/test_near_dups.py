import random
from collections import defaultdict

import numpy as np
import pytest

from peakforge.llm import near_dups as N

ROWS = "doc_id long, text string, lang string, key string, root string"


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(100):
        e, a = rng.integers(1, 1 << 62, 50).astype(np.uint64), rng.integers(0, 6, 50)
        b = np.where(rng.random(50) < 0.6, a, rng.integers(0, 6, 50))
        s = N.signatures([(e[a > 0], a[a > 0]), (e[b > 0], b[b > 0])], 130)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_signature_depends_on_the_multiset_alone():
    e = np.array([5, 9, 2], np.uint64)
    one = N.signatures([(e, np.array([1, 2, 3])), (e[:1], np.array([1]))], 130)
    two = N.signatures([(e[::-1], np.array([3, 2, 1]))], 130)
    assert (one[0] == two[0]).all() and np.isfinite(one).all()
    assert np.isinf(N.signatures([(e[:0], np.array([], int))], 130)).all()


def test_bags_and_overlaps():
    assert len(N.bag("a b c d e a b c d e a b c d e")) == 11 and len(set(N.bag("a b c d e " * 3).tolist())) == 11
    assert len(N.bag("one two")) == 1 and len(N.bag("...")) == 0 and len(N.bag(None)) == 0
    a, b = N.bag("a b c d e f g h"), N.bag("a b c d e f g x")
    assert N.overlaps(a, [b, a, N.bag("z")], piece=3).tolist() == [3, 4, 0]


def brute(rows):
    """Classes by comparing all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    bags, parent = [set(N.bag(t).tolist()) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]) - 1e-9:
                parent[find(i)] = find(j)
    where = {t: find(i) for i, t in enumerate(texts)}
    least = defaultdict(lambda: None)
    for i, t in rows:
        if t is not None and i is not None and (least[where[t]] is None or i < least[where[t]]):
            least[where[t]] = i
    return {(i, t): i if t is None else least[where[t]] for i, t in rows}


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, None), (n + 2, ""), (n + 3, ""), (n + 4, "!!"), (n + 5, "Same words, here"), (n + 6, "same WORDS here"), (n + 7, "x " * 5000), (n + 8, "x " * 5001), (None, rows[0][1])]


@pytest.mark.parametrize("block", [1024, 20])
def test_classes_against_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "l", "k", "r") for i, t in rows], ROWS).repartition(5)
    out = N.near_duplicates(df, config=N.NearConfig(block=block)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    by_id = {i: c for (i, _), c in want.items()}
    assert {r.doc_id: r.class_id for r in out} == by_id


def test_one_of_each_class_stays(spark):
    rows = corpus(200)
    df = spark.createDataFrame([(i, t, "l", "k", "r") for i, t in rows + rows[:3]], ROWS)
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = sorted({(c, t is None) for (_, t), c in brute(rows).items()}, key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((c for c, _ in want), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert N.near_duplicates(df).count() == 0 and N.drop_near_duplicates(df).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (7, 7)] + [(100, i) for i in range(101, 140)], "a long, b long")
    out = {r.key: r.root for r in N.components(links).collect()}
    assert all(out[i] == 1 for i in range(1, 6)) and out[11] == 10 and out[7] == 7 and {out[i] for i in range(100, 140)} == {100}


def test_keys_whose_first_hash_agrees(spark, monkeypatch):
    """Texts of one 64-bit hash are told apart by the second: here a hash of four values."""
    from pyspark.sql import functions as F

    rows = corpus(60)
    df = spark.createDataFrame([(i, t, "l", "k", "r") for i, t in rows], ROWS)
    weak = F.length("text") % 4
    clash = df.filter("text is not null").groupBy(weak.cast("long").alias("key")).agg(F.countDistinct("text").alias("n")).filter("n > 1").count()
    assert clash > 1
    key = N._key_of(F.col("text"), [r[0] for r in df.filter("text is not null").select(F.xxhash64("text")).limit(5).collect()])
    got = df.select("text", key.alias("key")).filter("text is not null").groupBy("key").agg(F.countDistinct("text").alias("n"))
    assert got.filter("n > 1").count() == 0 and df.select(key.alias("key")).filter("key is null").count() == 2


def test_clashing_names(spark):
    names = "doc_id text __key __id __keys key id root first known __part class_id".split()
    df = spark.createDataFrame([(i, "a b c d e f g", *names[2:]) for i in range(4)], names)
    row = N.drop_near_duplicates(df).collect()
    assert len(row) == 1 and all(row[0][n] == n for n in names[2:])
    assert {r.class_id for r in N.near_duplicates(df).collect()} == {0}


def test_one_text_holds_most_rows(spark):
    rows = [(i, "the same text in most of the rows" if i % 3 else f"other {i} words of its own kind") for i in range(3000)] + [(None, "the same text in most of the rows")] * 3
    df = spark.createDataFrame([(i, t, "l", "k", "r") for i, t in rows], ROWS)
    out = N.near_duplicates(df).collect()
    assert len(out) == 3003 and all(r.class_id == (1 if r.doc_id is None or r.doc_id % 3 else r.doc_id) for r in out)
    assert N.drop_near_duplicates(df).count() == 1001


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from peakforge.llm import common

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            common.shared_dir(unset(master))
    assert common.shared_dir(unset("local[4]")).startswith("file://")
