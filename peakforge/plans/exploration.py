"""Analytics queries."""

from pyspark.sql import functions as F

from ..operators import exploration as X
from ..operators.model import mean_squared_error as mse
from .registry import PEAKS, RESULTS, peaks, query, results, rounded, table


@query(f"WITH {PEAKS}, n AS (SELECT spectrum_id, count(*) AS c FROM pk GROUP BY spectrum_id) SELECT count(*) AS n_rows, count(o_custkey) AS n_structure, count(DISTINCT o_custkey) AS distinct_structure, count(nullif(o_orderstatus, 'P')) AS n_mode, count(DISTINCT nullif(o_orderstatus, 'P')) AS distinct_mode, count(*) FILTER (WHERE c < 3) AS n_few_peaks, count(*) FILTER (WHERE c > 8) AS n_many_peaks FROM orders JOIN n ON spectrum_id = o_orderkey")
def coverage_report(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum_id"), F.col("o_custkey").alias("structure"), F.nullif("o_orderstatus", F.lit("P")).alias("mode"))
    return X.coverage(o.join(peaks(spark, d), "spectrum_id"), ["structure", "mode"], F.size("peaks"), 3, 8)


@query(f"WITH {RESULTS} SELECT t AS threshold, count(*) FILTER (WHERE score > t) AS hits, count(*) FILTER (WHERE score > t AND exact) AS \"right\", count(*) AS total, count(*) FILTER (WHERE score > t AND exact) / nullif(count(*) FILTER (WHERE score > t), 0) AS precision, count(*) FILTER (WHERE score > t) / count(*) AS recall FROM res, (SELECT unnest([0.1, 0.3, 0.5, 0.9])::DOUBLE AS t) GROUP BY t")
def precision_recall_at(spark, d):
    return X.precision_recall(results(spark, d), [0.1, 0.3, 0.5, 0.9])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return X.value_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("value")), "value")


@query("SELECT round(quantile_cont(value, 0.5), 6) AS q0, round(quantile_cont(value, 0.9), 6) AS q1 FROM events")
def quantile(spark, d):
    q = X.quantiles(table(spark, d, "events"), "value", [0.5, 0.9])
    return q.select(*[rounded(c).alias(c) for c in q.columns])


@query("WITH c AS (SELECT corr(l_quantity, l_quantity) AS a, corr(l_quantity, l_extendedprice) AS b, corr(l_quantity, l_discount) AS c, corr(l_extendedprice, l_extendedprice) AS d, corr(l_extendedprice, l_discount) AS e, corr(l_discount, l_discount) AS f FROM lineitem) SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(c.a, 6) AS r FROM c UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(c.b, 6) FROM c UNION ALL SELECT 'l_quantity', 'l_discount', round(c.c, 6) FROM c UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(c.d, 6) FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', round(c.e, 6) FROM c UNION ALL SELECT 'l_discount', 'l_discount', round(c.f, 6) FROM c")
def corr(spark, d):
    return X.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", rounded("r").alias("r"))


@query(f"WITH {RESULTS} SELECT method, fold, round(sum(score * pow(k / 100, 2)) / nullif(sum(pow(k / 100, 2)), 0), 6) AS weighted FROM res GROUP BY method, fold")
def weighted_neighbourhood(spark, d):
    r = results(spark, d).withColumn("t", F.col("k") / 100)
    return X.weighted_neighbourhood(r, ["method", "fold"], "score", "t", 2).select("method", "fold", rounded("weighted").alias("weighted"))


@query(f"WITH {RESULTS} SELECT count(*) FILTER (WHERE score > 0.5 AND k / 100 < 0.1) AS n_exact, count(*) FILTER (WHERE score > 0.5 AND k / 100 >= 0.1) AS n_analog FROM res")
def analog_vs_exact(spark, d):
    return X.analog_or_exact(results(spark, d), F.col("k") / 100, 0.5)


@query(f"WITH {RESULTS} SELECT t AS threshold, count(*) AS n, sum(k) / count(k) AS mean FROM res, (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS t) WHERE k IS NOT NULL AND score > t GROUP BY t")
def mean_above_threshold(spark, d):
    return X.mean_above(results(spark, d), "k", [0.2, 0.4, 0.6], F.col("k").isNotNull())


@query(f"WITH {RESULTS}, b AS (SELECT fold, query_id // 10 AS q, max(score) AS best FROM res GROUP BY ALL) SELECT fold, count(*) AS n, count(*) FILTER (WHERE best > 0.7) AS n_above FROM b GROUP BY fold")
def share_above(spark, d):
    return X.share_above(results(spark, d).withColumn("query_id", F.floor(F.col("query_id") / 10)), 0.7)


@query("SELECT o_custkey AS structure, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def multi_spectrum_structures(spark, d):
    return X.with_several(table(spark, d, "orders").select(F.col("o_custkey").alias("structure")), "structure")


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey AS structure, n, row_number() OVER w AS position, (sum(n) OVER w)::BIGINT AS cumulative FROM c WINDOW w AS (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING)")
def cumulative_sizes(spark, d):
    return X.cumulative_sizes(table(spark, d, "orders").select(F.col("o_custkey").alias("structure")), "structure")


@query(f"WITH {RESULTS}, g AS (SELECT i AS step, 0.95::DOUBLE / 20 * i AS cut FROM range(20) r(i)) SELECT step, cut, count(*) AS n, sum(k) / count(k) AS mean, (SELECT count(*) FROM res) AS total FROM res JOIN g ON score > cut GROUP BY step, cut")
def recall_grid(spark, d):
    return X.recall_grid(results(spark, d), "k", 20, 0.95)


@query("SELECT event_id, value, rank FROM (SELECT event_id, value, row_number() OVER (PARTITION BY event_id // 2000 ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 100")
def first_k_per_block(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return X.first_of_block(e, F.floor(F.col("event_id") / 2000), [F.desc("value"), "event_id"], 100).select("event_id", "value", "rank")


@query("WITH e AS (SELECT event_id, user_id, (props->>'$.k')::BIGINT AS size FROM events) SELECT event_id, user_id, size FROM (SELECT *, max(size) OVER (PARTITION BY user_id) AS most, row_number() OVER (PARTITION BY user_id ORDER BY size DESC, event_id) AS r FROM e) WHERE size >= 95 OR most < 95 AND r = 1")
def large_or_largest(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("size"))
    return X.large_or_largest(e, "user_id", "size", "event_id", 95)


@query(f"WITH {RESULTS} SELECT round(avg(pow(k / 100 - score, 2)), 6) AS mse FROM res")
def mean_squared_error(spark, d):
    r = results(spark, d).withColumn("t", F.col("k") / 100)
    return mse(r, "t", "score").select(rounded("mse").alias("mse"))
