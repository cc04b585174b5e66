import math
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from peakforge.llm.url_filter import MarkovConfig, MarkovRatio, best_cut, fit_markov_ratio, fold_of, judge_urls, score_urls

BIGGER = Path("/root/testdata/sf0.1")


def brute_scores(train, urls, order, alphabet):
    """Witten-Bell interpolation straight from its definition."""

    def fit(texts):
        n = defaultdict(lambda: defaultdict(int))
        for t in texts:
            s = "\x02" * order + t.lower() + "\x03"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    n[s[i - k : i]][s[i]] += 1
        return n

    def p(n, h, c):
        low = p(n, h[1:], c) if h else 1 / alphabet
        own = n.get(h)
        if not own:
            return low
        return (own.get(c, 0) + len(own) * low) / (sum(own.values()) + len(own))

    a, r = fit(u for u, y in train if y), fit(u for u, y in train if not y)
    out = {}
    for u in urls:
        s = "\x02" * order + u.lower() + "\x03"
        d = [math.log(p(a, s[i - order : i], s[i])) - math.log(p(r, s[i - order : i], s[i])) for i in range(order, len(s))]
        out[u] = sum(d) / len(d)
    return out


def test_scores_against_brute_force(spark):
    train = [(f"http://good.org/en/{i}", True) for i in range(40)] + [(f"http://bad.com/spam{i}?x", False) for i in range(40)]
    df = spark.createDataFrame(train, "url string, accepted boolean")
    model = fit_markov_ratio(df, MarkovConfig(order=2))
    fold = {r.url for r in df.filter(fold_of(F.col("url")) != 0).collect()}
    urls = ["http://good.org/en/99", "http://bad.com/spam9?x", "zzz", "", "HTTP://Good.ORG/É"]
    want = brute_scores([t for t in train if t[0] in fold], urls, 2, 256)
    got = {r.url: r.score for r in score_urls(spark.createDataFrame([(u,) for u in urls], "url string"), model).collect()}
    assert got == pytest.approx(want)
    assert got[urls[0]] > model.threshold >= got[urls[1]]


def test_fits_on_every_labelled_url(spark):
    """More URLs a class than any sample held, each with a number of its own: counts and cut are those of all."""
    train = [(f"http://a.org/{i * 7919 % 10007}", True) for i in range(5500)] + [(f"http://b.com/x{i * 6007 % 10007}", False) for i in range(5500)]
    df = spark.createDataFrame(train, "url string, accepted boolean")
    model = fit_markov_ratio(df, MarkovConfig(order=2))
    fold = {r.url for r in df.filter(fold_of(F.col("url")) != 0).collect()}
    urls = [u for u, _ in train if u not in fold]
    want = brute_scores([t for t in train if t[0] in fold], urls, 2, 256)
    total = model.grams.filter("gram = '\u0003'").first()
    assert (total.a, total.r) == tuple(sum(u in fold and y == kind for u, y in train) for kind in (True, False)) and min(total.a, total.r) > 4000
    got = {r.url: r.score for r in score_urls(spark.createDataFrame([(u,) for u in urls[::50]], "url string"), model).collect()}
    assert got == pytest.approx({u: want[u] for u in urls[::50]})
    kind = dict(train)
    low, high = max(want[u] for u in urls if not kind[u]), min(want[u] for u in urls if kind[u])
    assert low < high and model.threshold == pytest.approx((low + high) / 2)


@pytest.mark.parametrize("n", [1, 7, 60, 900])
def test_cut_over_ranges(spark, n):
    """Classes that overlap, with repeated scores, against the definition."""
    rng = random.Random(n)
    rows = [(rng.randrange(-n, n) / 8 + y * n / 16, y) for y in (True, False) for _ in range(n)]
    values = sorted({s for s, _ in rows})
    gains = [sum(s < v and not y for s, y in rows) / n - sum(s < v and y for s, y in rows) / n for v in values]
    at = gains.index(max(gains))
    df = spark.createDataFrame(rows, "score double, accepted boolean")
    assert best_cut(df) == (values[at] + values[max(at - 1, 0)]) / 2
    assert best_cut(df.filter("accepted")) == 0.0


def test_rules_and_edge_cases(spark):
    urls = [
        ("http://a.b.org/x?q", "a.b.org", "/x", "org/", "allow"),
        ("http://Example.org/es/1#t", "example.org", "/es/1", "example.org/es/", "block"),
        ("x://www.example.org/en/12", "www.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.com/fr/", "example.com", "/fr/", "com/fr/", "allow"),
        ("http://example.com/de/1", "example.com", "/de/1", "com/de/", "block"),
        ("http://xorg/", "xorg", "/", None, None),
        ("http://b.org?x=://y", "b.org", "", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "mine") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string")
    out = {r.page_id: r for r in judge_urls(df).collect()}
    assert len(out) == 12
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict in ("allow", "block") if verdict is None else out[i].verdict == verdict
    assert out[9].score is None and out[10].score == out[0].score


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert judge_urls(one).first().verdict == "allow"  # nothing to learn from
    assert isinstance(fit_markov_ratio(spark.createDataFrame([], "url string, accepted boolean")), MarkovRatio)


def test_clashing_names_and_a_long_url(spark):
    names = ["page_id", "url", "__url", "__score", "__s", "__i", "score_", "gram"]
    rows = [(i, f"http://good.org/en/{i}" if i % 2 else f"http://example.com/de/{i}", *names[2:]) for i in range(40)] + [(99, "http://z.net/" + "abc/" * 20000, *names[2:])]
    out = judge_urls(spark.createDataFrame(rows, names)).collect()
    assert len(out) == 41 and all(r[n] == n for r in out for n in names[2:]) and all(r.score is not None for r in out)


@pytest.mark.skipif(not BIGGER.exists(), reason="no test data")
def test_held_out_accuracy(spark):
    """Models fitted on a part of the URLs that the rules label, judged by the rules' verdicts on the rest."""
    pages = spark.read.parquet(f"{BIGGER}/pages.parquet")
    judged = judge_urls(pages.select("page_id", "url")).filter("rule is not null").select("url", (F.col("verdict") == "allow").alias("accepted")).distinct()
    away = F.conv(F.substring(F.md5(F.reverse("url")), 1, 8), 16, 10).cast("long") % 5 == 0
    model = fit_markov_ratio(judged.filter(~away))
    rest = judged.filter(away)
    scored = score_urls(rest.select("url"), model).join(rest, "url").collect()
    right = sum((r.score >= model.threshold) == r.accepted for r in scored)
    assert len(scored) > 20 and right >= 0.9 * len(scored)
