"""Split queries."""

from pyspark.sql import functions as F

from ..operators import splits as T
from .registry import query, table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey")


_KEYS = "k AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey || '|42'), o_custkey) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))"
_SETS = f"{_KEYS}, s AS (SELECT o_custkey, CASE WHEN rank - 1 < 7 * (n // 7) THEN (rank - 1) // (n // 7) ELSE rank - 1 - 7 * (n // 7) END AS set_no FROM k)"


@query(f"WITH {_KEYS} SELECT o_orderkey, o_custkey, rank > n - n // 20 AS held_out FROM orders JOIN k USING (o_custkey)")
def holdout_structures(spark, d):
    return T.holdout_structures(_orders(spark, d), "o_custkey", 20).select("o_orderkey", "o_custkey", "held_out")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) > count(*) OVER () - ceil(count(*) OVER () / 10) AS held_out FROM orders")
def holdout_rows(spark, d):
    return T.holdout_rows(_orders(spark, d), "o_orderkey", 10)


@query(f"WITH {_SETS} SELECT o_custkey, set_no FROM s")
def k_sets(spark, d):
    return T.k_sets(_orders(spark, d), "o_custkey", 7)


@query(f"WITH {_SETS} SELECT fold, is_test, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM (SELECT fold, fold = set_no AS is_test, o_orderkey FROM orders JOIN s USING (o_custkey), range(7) f(fold)) GROUP BY fold, is_test")
def kfold_analogue(spark, d):
    return T.analogue_folds(_orders(spark, d), "o_custkey", 7).groupBy("fold", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query(
    """WITH r AS (SELECT fold, o_custkey, o_orderkey, row_number() OVER (PARTITION BY fold, o_custkey ORDER BY md5(o_orderkey || '|42|' || fold), o_orderkey) AS pos, count(*) OVER (PARTITION BY fold, o_custkey) AS n FROM orders, range(3) f(fold))
 SELECT fold, o_custkey, o_orderkey, pos = 1 AND n > 1 AS is_test FROM r"""
)
def kfold_exact(spark, d):
    return T.exact_folds(_orders(spark, d), "o_custkey", "o_orderkey", 3).select("fold", "o_custkey", "o_orderkey", "is_test")


_PICK = "('0x' || substring(md5(o_orderkey || '|42{0}'), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey AS query_id, {_PICK.format('a')} % (SELECT count(*) FROM orders) AS spectrum_id, {_PICK.format('b')} / 4294967296.0::DOUBLE AS score FROM orders")
def random_baseline(spark, d):
    """Picks among as many positions as there are spectra."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"))
    return T.random_pick(orders, orders.count())


@query(
    f"""WITH {_KEYS}, c AS (SELECT o_custkey, rank, count(*) AS m, arg_min(o_orderkey, (md5(o_orderkey || '|42'), o_orderkey)) AS first FROM orders JOIN k USING (o_custkey) GROUP BY o_custkey, rank),
 w AS (SELECT o_custkey, first, row_number() OVER (ORDER BY rank) AS pos FROM c WHERE rank > 100 AND m > 1)
 SELECT o_orderkey, CASE WHEN k.rank <= 100 THEN 'structures' WHEN w.pos <= 300 AND w.first = o_orderkey THEN 'rows' ELSE 'train' END AS part FROM orders JOIN k USING (o_custkey) LEFT JOIN w USING (o_custkey)"""
)
def structure_and_row_holdout(spark, d):
    return T.structure_and_row_holdout(_orders(spark, d), "o_custkey", "o_orderkey", 100, 300).select("o_orderkey", "part")
