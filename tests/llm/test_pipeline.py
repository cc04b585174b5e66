"""The corpus pipeline against plain Python, stage by stage."""

import random
import re

import pytest

import corpus_pipeline as C
from peakforge.llm import decontaminate as D
from peakforge.llm import secret_scan as S

from ..compare import DATA
from .test_near_dups import brute

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = {"en": [a + b for a in ("th", "er", "on", "at") for b in ("ing", "ed", "ly", "ou")], "fr": [a + b for a in ("eau", "ch", "qu", "oi") for b in ("ment", "eux", "aire", "elle")]}
    rows = []
    for i in range(300):
        lang = rng.choice(("en", "fr"))
        rows.append([i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(8, 60))), lang if rng.random() < 0.9 else None, f"s{i % 4}"])
    item = " ".join(rng.choice(vocabulary["en"]) for _ in range(20))
    rows[3][1] += " " + item
    rows[4][1] = rows[5][1]
    rows[6][1] += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows += [[300, None, "en", "s0"], [301, "", "en", None], [302, "12 34", "en", "s1"], [303, "один два три", None, "s2"]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], ROWS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [(r[0], r[1]) for r in rows], item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = dict(rows)
    a = C.identify_language(spark, docs, path)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == set(range(300))
    b = C.drop_near_duplicates(spark, a, path)
    assert {r.doc_id for r in b.collect()} == set(brute(rows[:300]).values())
    c = C.drop_benchmark(spark, b, path)
    leaked = {i for i, t in rows[:300] if D.PieceIndex.build([(1, item)]).search(t)}
    assert 3 in leaked and {r.doc_id for r in c.collect()} == set(brute(rows[:300]).values()) - leaked
    d = C.redact_secrets(spark, c, path).collect()
    for r in d:
        assert r.n_chars == len(r.text) and not any(re.search(x.pattern, r.text) for x in S.BASE_RULES)
        assert r.doc_id == 6 or r.text == texts[r.doc_id]
    e = C.mix_sources(spark, C.redact_secrets(spark, c, path), path).collect()
    assert all(1 <= r.copies <= 2 and r.taken == r.copies * r.size for r in e)


def test_run_equals_the_stages(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, path)
    got = sorted((r.doc_id, r.taken) for r in C.run(spark, path).collect())
    assert got == sorted((r.doc_id, r.taken) for r in docs.collect()) and got


def test_empty_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert C.identify_language(spark, docs, str(DATA)).count() == docs.count()
