"""Evaluation queries."""

from pyspark.sql import functions as F

from ..functions.sets import bit_jaccard, nearest_by_bits
from ..operators import evaluation as E
from .library import _TANI, _fingerprints
from .registry import RESULTS, query, results, rounded, table

_CURVE = f"""{RESULTS}, tot AS (SELECT fold, method, count(*) AS total FROM res GROUP BY fold, method),
 cur AS (SELECT fold, method, query_id, row_number() OVER w AS rank, sum(k) OVER w AS sk, sum(exact::INT) OVER w AS se FROM res WHERE score IS NOT NULL WINDOW w AS (PARTITION BY fold, method ORDER BY score DESC, query_id ROWS UNBOUNDED PRECEDING)),
 curve AS (SELECT cur.*, total, sk / rank AS running_k, se * 100 / rank AS running_e FROM cur JOIN tot USING (fold, method))"""


def _tanimoto_curve(spark, d):
    return E.recall_curve(results(spark, d), "k")


@query(f"WITH {_CURVE} SELECT fold, method, query_id, rank, total, rank * 100.0::DOUBLE / total AS recall, running_k AS mean_percent FROM curve")
def recall_tanimoto_curve(spark, d):
    return _tanimoto_curve(spark, d).select("fold", "method", "query_id", "rank", "total", "recall", F.col("running").alias("mean_percent"))


@query(f"WITH {_CURVE} SELECT fold, method, query_id, rank, total, running_e AS exact_percent FROM curve")
def recall_exact_curve(spark, d):
    r = results(spark, d).withColumn("hit", F.col("exact").cast("long") * 100)
    return E.recall_curve(r, "hit").select("fold", "method", "query_id", "rank", "total", F.col("running").alias("exact_percent"))


_BINS = f"""{_CURVE}, b AS (SELECT fold, method, (ceil(rank * {{n}} / total) - 1)::BIGINT AS bin, avg(running_k) AS mean FROM curve GROUP BY ALL),
 grid AS (SELECT fold, method, bin FROM tot, range({{n}}) g(bin)), binned AS (SELECT fold, method, bin, coalesce(mean, 0) AS mean FROM grid LEFT JOIN b USING (fold, method, bin))"""


@query(f"WITH {_BINS.format(n=1000)} SELECT fold, method, bin, round(mean, 6) AS mean FROM binned")
def binned_recall(spark, d):
    return E.binned_curve(_tanimoto_curve(spark, d)).select("fold", "method", "bin", rounded("mean").alias("mean"))


@query(f"WITH {_BINS.format(n=100)} SELECT method, bin, round(avg(mean), 6) AS mean_value, round(stddev_samp(mean), 6) AS sd_value FROM binned GROUP BY method, bin")
def fold_mean_std(spark, d):
    m = E.mean_and_deviation(E.binned_curve(_tanimoto_curve(spark, d), 100))
    return m.select("method", "bin", rounded("mean_value").alias("mean_value"), rounded("sd_value").alias("sd_value"))


_CUT = f"""{RESULTS}, n AS (SELECT method, count(*) AS n, count(*) FILTER (WHERE score > 0) AS positive FROM res GROUP BY method),
 r AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score DESC, query_id) AS rank FROM res WHERE score IS NOT NULL),
 cut AS (SELECT n.method, CASE WHEN positive <= floor(n * 0.35) THEN 0 ELSE ceil(round(score * 10000, 6))::BIGINT END AS k FROM n LEFT JOIN r ON r.method = n.method AND r.rank = floor(n.n * 0.35) + 1)"""


@query(f"WITH {_CUT} SELECT method, k, k / 10000.0::DOUBLE AS threshold FROM cut")
def threshold_for_recall(spark, d):
    return E.threshold_for_recall(results(spark, d), 0.35)


@query(f"WITH {_CUT}, a AS (SELECT method, least(floor(res.k / 100 * 10), 9)::BIGINT AS bin FROM res JOIN cut USING (method) WHERE score > cut.k / 10000) SELECT method, bin, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY method) AS percent FROM a GROUP BY method, bin")
def score_distribution(spark, d):
    return E.distribution_at_recall(results(spark, d), 0.35, F.col("k") / 100)


@query(f"WITH {RESULTS}, a AS (SELECT method, least(floor(k / 100 * 10), 9)::BIGINT AS bin FROM res WHERE k IS NOT NULL) SELECT method, bin, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY method) AS percent FROM a GROUP BY method, bin")
def tanimoto_histogram(spark, d):
    return E.fixed_histogram(results(spark, d), F.col("k") / 100, 10, ("method",))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 WHEN n < 15 THEN 2 ELSE 3 END::BIGINT AS bin, count(*) AS n FROM c WHERE n BETWEEN 1 AND 1000 GROUP BY 1")
def irregular_histogram(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return E.irregular_histogram(c, F.col("n"), [1, 5, 10, 15, 1000])


@query(f"WITH {RESULTS} SELECT method, CASE WHEN score * 5000 < 300 THEN 0 WHEN score * 5000 < 600 THEN 1 WHEN score * 5000 < 5000 THEN 2 END::BIGINT AS bin, count(*) AS n, sum(k) / count(k) AS mean_percent FROM res WHERE score IS NOT NULL GROUP BY ALL")
def mass_binned(spark, d):
    r = results(spark, d).filter("score is not null").withColumn("bin", E.mass_bin(F.col("score") * 5000))
    return r.groupBy("method", "bin").agg(F.count(F.lit(1)).alias("n"), (F.sum("k") / F.count("k")).alias("mean_percent"))


@query(f"WITH {_TANI}, b AS (SELECT key_1, key_2, tanimoto FROM (SELECT *, row_number() OVER (PARTITION BY key_1 ORDER BY tanimoto DESC, key_2) AS r FROM t WHERE key_1 % 2 = 0 AND key_2 % 2 = 1) WHERE r = 1) SELECT s_suppkey AS query_id, tanimoto AS score, tanimoto, s_suppkey = key_2 AS exact FROM supplier LEFT JOIN b ON key_1 = s_suppkey")
def optimal_baseline(spark, d):
    """Even suppliers are test structures, odd ones the training structures."""
    tests = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("key"))
    f = _fingerprints(spark, d)
    return E.optimal_matches(tests, nearest_by_bits(f.filter("key % 2 = 0"), f.filter("key % 2 = 1"), 1))


@query(
    f"""WITH {_TANI}, f AS (SELECT s_suppkey AS query_id, s_acctbal AS score, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE (s_suppkey * 7) % (SELECT count(*) FROM supplier) END AS key_found FROM supplier WHERE s_suppkey % 3 <> 0)
 SELECT s_suppkey AS query_id, score, CASE WHEN key_found IS NOT NULL THEN coalesce(tanimoto, 0.0) END AS tanimoto, key_found = s_suppkey AS exact FROM supplier LEFT JOIN f ON query_id = s_suppkey LEFT JOIN t ON key_1 = s_suppkey AND key_2 = key_found"""
)
def match_results(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    found = s.filter(key % 3 != 0).join(F.broadcast(n)).select(key.alias("query_id"), F.col("s_acctbal").alias("score"), F.when(key % 4 == 0, key).otherwise((key * 7) % F.col("n")).alias("key_found"))
    tests, f = s.select(key.alias("query_id"), key.alias("key")), _fingerprints(spark, d)
    wanted = tests.join(found, "query_id").select(F.col("key").alias("key_1"), F.col("key_found").alias("key_2")).distinct()
    pairs = wanted.join(f.toDF("key_1", "x"), "key_1").join(f.toDF("key_2", "y"), "key_2")  # the wanted pairs only
    return E.match_results(tests, found, pairs.select("key_1", "key_2", bit_jaccard(F.col("x"), F.col("y"), 1).alias("tanimoto")))


@query("SELECT least(floor(k / 100 * 10), 9)::BIGINT AS bin, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM (SELECT value, (props->>'$.k')::BIGINT AS k FROM events) WHERE value > 100 AND value < 300 GROUP BY 1")
def mass_range_distribution(spark, d):
    e = table(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return E.mass_range_distribution(e, "value", 100, 300, F.col("k") / 100)


@query(f"WITH {_TANI} SELECT key_1 AS key, max(tanimoto) AS tanimoto FROM t WHERE key_1 % 10 = 0 AND key_2 % 10 <> 0 GROUP BY key_1")
def optimal_other_structure(spark, d):
    tests = table(spark, d, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("key"))
    f = _fingerprints(spark, d)
    own, others = f.join(tests, "key", "left_semi"), f.join(tests, "key", "left_anti")
    return E.optimal_other(nearest_by_bits(own, others, 1), tests)
