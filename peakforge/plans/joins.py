"""Join, set and lookup queries."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from .registry import long, query, spectra, table


@query("SELECT event_id, value FROM events WHERE value BETWEEN 100 AND 120")
def precursor_window(spark, d):
    return J.range_scan(table(spark, d, "events").select("event_id", "value"), "value", 100, 120)


def _mass_pairs(spark, d, tolerance, apart=False):
    """The stated query set, events with an id divisible by 50, against all events; ``apart``: a query does not match itself."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    q = e.filter("event_id % 50 = 0").select(F.col("event_id").alias("query_id"), F.col("value").alias("q_mz"))
    lib = e.select(F.col("event_id").alias("spectrum_id"), F.col("value").alias("mz"), "k")
    pairs = J.band_join(q, lib, "q_mz", "mz", tolerance)
    return pairs.filter("query_id <> spectrum_id") if apart else pairs


_MASS = "p AS (SELECT q.event_id AS query_id, l.event_id AS spectrum_id, q.value AS q_mz, l.value AS mz, (l.props->>'$.k')::BIGINT AS k FROM events q JOIN events l ON abs(q.value - l.value) <= {t} WHERE q.event_id % 50 = 0{apart})"
_APART = " AND q.event_id <> l.event_id"


@query(f"WITH {_MASS.format(t=0.25, apart="")} SELECT * FROM p")
def band_join(spark, d):
    return _mass_pairs(spark, d, 0.25)


@query(f"WITH {_MASS.format(t=0.25, apart=_APART)} SELECT query_id, spectrum_id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, spectrum_id) AS r FROM p) WHERE r = 1")
def best_in_mass_window(spark, d):
    return E.best_in_mass_window(_mass_pairs(spark, d, 0.25, apart=True), "k").select("query_id", "spectrum_id", "k")


@query(f"WITH {_MASS.format(t=0.5, apart="")} SELECT query_id, spectrum_id FROM p WHERE mz BETWEEN q_mz - q_mz * 200 / 1e6 AND q_mz + q_mz * 200 / 1e6")
def ppm_match(spark, d):
    low, high = J.ppm_window(F.col("q_mz"), 200)
    return _mass_pairs(spark, d, 0.5).filter(F.col("mz").between(low, high)).select("query_id", "spectrum_id")


@query(f"WITH {_MASS.format(t=0.2, apart=_APART)}, a AS (SELECT query_id, spectrum_id FROM p WHERE abs(q_mz - mz) <= 0.005) SELECT *, 1::BIGINT AS tier FROM a UNION ALL SELECT query_id, spectrum_id, 2 FROM p WHERE query_id NOT IN (SELECT query_id FROM a)")
def two_tier_match(spark, d):
    near = [_mass_pairs(spark, d, t, apart=True).select("query_id", "spectrum_id") for t in (0.005, 0.2)]
    return J.first_tier(near, "query_id")


@query(f"WITH {_MASS.format(t=1.2, apart=_APART)} SELECT query_id, spectrum_id, w::BIGINT AS shift FROM p, range(3) r(w), (SELECT [0.0, 1.0078, -1.0078]::DOUBLE[] AS ds) WHERE mz BETWEEN (q_mz + ds[w + 1]) - (q_mz + ds[w + 1]) * 50 / 1e6 AND (q_mz + ds[w + 1]) + (q_mz + ds[w + 1]) * 50 / 1e6")
def adduct_match(spark, d):
    """Masses within 50 ppm of the query's, or of it with a hydrogen more or less."""
    pairs = _mass_pairs(spark, d, 1.2, apart=True).select("query_id", "spectrum_id", "mz", F.posexplode(J.adduct_windows(F.col("q_mz"), 50)).alias("shift", "w"))
    return pairs.filter(F.col("mz").between(F.col("w.low"), F.col("w.high"))).select("query_id", "spectrum_id", long("shift").alias("shift"))


@query(f"WITH {_MASS.format(t=0.25, apart=_APART)} SELECT query_id, arg_max(spectrum_id, (k, -spectrum_id)) AS spectrum_id, max(k) AS k, count(*) AS n_candidates FROM p WHERE k >= 70 GROUP BY query_id")
def best_above(spark, d):
    return E.best_above(_mass_pairs(spark, d, 0.25, apart=True), 70, "k").select("query_id", "spectrum_id", "k", "n_candidates")


@query(f"WITH {_MASS.format(t=0.25, apart=_APART)} SELECT query_id, spectrum_id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, spectrum_id) AS r FROM p WHERE pow(0.8, abs(q_mz - mz) / 0.05) > pow(0.8, 2.5)) WHERE r = 1")
def best_of_similar_mass(spark, d):
    from ..operators.suites import mass_similarity

    near = mass_similarity(F.col("q_mz"), F.col("mz"), scale=0.05)
    return E.best_of_similar_mass(_mass_pairs(spark, d, 0.25, apart=True), near, 0.8**2.5, "k").select("query_id", "spectrum_id", "k")


@query("SELECT event_id, value FROM events WHERE value > 100 AND value < 120.01")
def open_interval(spark, d):
    return J.open_interval(table(spark, d, "events").select("event_id", "value"), "value", 100, 120.01)


@query("""SELECT 'both' AS side, o.o_orderkey AS l, c.c_custkey AS r FROM orders o JOIN customer c ON abs(o.o_totalprice - c.c_acctbal) <= 0.05 UNION ALL
 SELECT 'left', o.o_orderkey, NULL FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE abs(o.o_totalprice - c.c_acctbal) <= 0.05)""")
def band_join_left(spark, d):
    """Rows without a partner stay."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l"), "o_totalprice", F.lit(None).cast("string").alias("note"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("r"), "c_acctbal")
    out = J.band_join(o, c, "o_totalprice", "c_acctbal", 0.05, "left")
    return out.select(F.when(F.col("r").isNull(), "left").otherwise("both").alias("side"), "l", "r")


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_nationkey IS NULL THEN 'anti' ELSE 'semi' END AS part FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 5) ON o_custkey = c_custkey")
def semi_anti_split(spark, d):
    keys = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    yes, no = J.semi_anti_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")
    return yes.withColumn("part", F.lit("semi")).unionAll(no.withColumn("part", F.lit("anti")))


@query("SELECT c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def lookup_metadata(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    out = J.lookup_join(c, table(spark, d, "nation").withColumnRenamed("n_name", "nation"), "n_nationkey")
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return J.lookup_join(out, regions, "n_regionkey").select("id", "name", "nation", "region")


@query("SELECT round(c_acctbal / 100, 0) AS mass, c_nationkey::BIGINT AS nation, c_custkey, s_suppkey FROM customer JOIN supplier ON round(c_acctbal / 100, 0) = round(s_acctbal / 100, 0) AND c_nationkey = s_nationkey")
def rounded_natural_join(spark, d):
    c = table(spark, d, "customer").select((F.col("c_acctbal") / 100).alias("mass"), long("c_nationkey").alias("nation"), "c_custkey")
    s = table(spark, d, "supplier").select((F.col("s_acctbal") / 100).alias("mass"), long("s_nationkey").alias("nation"), "s_suppkey")
    return J.rounded_join(c, s, ["mass", "nation"], 0)


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")).distinct().join(gone, "key", "left_anti")


@query("SELECT count(*) AS n_common FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_intersection(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "PF")
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_common"))


@query("SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem UNION SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def pair_union(spark, d):
    return J.pair_union(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")), "a", "b")


@query("SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def bag_union(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return a.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


def _peak_baseline(spark, d, kind):
    s = spectra(spark, d).withColumn("precursor_mz", F.col("precursor_mz") / 100)
    q = s.filter("spectrum_id % 50 = 0").withColumnRenamed("spectrum_id", "query_id")
    return E.peak_baseline(q, s, 5.56, kind, 0.1)


@query()
def greedy_cosine_baseline(spark, d):
    return _peak_baseline(spark, d, "greedy")


@query()
def modified_cosine_baseline(spark, d):
    return _peak_baseline(spark, d, "modified")
