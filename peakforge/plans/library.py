"""Library queries: structures, neighbours, representatives, classes, file round trips."""

from pyspark.sql import functions as F

from ..functions.sets import bit_jaccard, bit_words, nearest_by_bits
from ..operators import annotation as A
from ..operators import library as L
from ..sources.sinks import write_mgf
from ..sources.text_formats import read_gnps_json, read_mgf, read_msp
from .registry import LIBRARY, library, long, query, scratch, spectra, table


@query("SELECT o_custkey AS structure, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def ids_per_structure(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("structure"), F.col("o_orderkey").alias("spectrum_id"))
    return L.ids_per_structure(o, "structure").select("structure", F.array_join(F.transform("spectrum_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT DISTINCT substring(replace(c_name, 'Customer#', ''), 1, 14) || '-' || c_nationkey AS key FROM customer WHERE c_custkey % 3 <> 0")
def distinct_structures(spark, d):
    """Keys of 14 characters that many rows share in part, with rows that have none."""
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.concat(L.structure_key(F.replace("c_name", F.lit("Customer#"), F.lit(""))), F.lit("-"), "c_nationkey")).alias("key"))
    return L.distinct_structures(c, "key")


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS spectrum_id, o_orderkey FROM orders")
def number_spectra(spark, d):
    return L.number_spectra(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("spectrum_id", "o_orderkey")


@query(
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL)
 SELECT o_custkey AS structure, o_orderpriority AS inchi, first AS spectrum_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS r FROM c) WHERE r = 1"""
)
def representative_inchi(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("structure"), F.col("o_orderpriority").alias("inchi"), F.col("o_orderkey").alias("spectrum_id"))
    return L.representative(o, "structure", "inchi", "spectrum_id")


_TANI = """fp AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 64 AS b FROM lineitem), sz AS (SELECT s, count(*) AS n FROM fp GROUP BY s),
 c AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM fp x JOIN fp y ON x.b = y.b GROUP BY x.s, y.s),
 t AS (SELECT c.a AS key_1, c.b AS key_2, c.n / (p.n + q.n - c.n) AS tanimoto FROM c JOIN sz p ON p.s = c.a JOIN sz q ON q.s = c.b)"""


def _fingerprints(spark, d):
    """A supplier's fingerprint: bits of its part numbers modulo 64, as one word."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 64).alias("bit"))
    return lines.groupBy("key").agg(bit_words(F.collect_set("bit"), 64).alias("bits"))


def _tanimoto(spark, d):
    f = _fingerprints(spark, d)
    one, two = f.toDF("key_1", "x"), f.toDF("key_2", "y")
    return one.crossJoin(two).select("key_1", "key_2", bit_jaccard(F.col("x"), F.col("y"), 1).alias("tanimoto")).filter("tanimoto > 0")


@query(f"WITH {_TANI} SELECT * FROM t")
def tanimoto_matrix(spark, d):
    """The dense matrix of all structures is the reference's own operator; its size is the square of the structures' number."""
    return _tanimoto(spark, d)


@query(f"WITH {_TANI} SELECT key_1, key_2, tanimoto, rank FROM (SELECT *, row_number() OVER (PARTITION BY key_1 ORDER BY tanimoto DESC, key_2) AS rank FROM t) WHERE rank <= 10")
def closest_structures(spark, d):
    f = _fingerprints(spark, d)
    return nearest_by_bits(f, f, 10)


@query(
    """WITH fp AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS b FROM lineitem), sz AS (SELECT s, count(*) AS n FROM fp GROUP BY s),
 c AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM fp x JOIN fp y ON x.b = y.b GROUP BY x.s, y.s) SELECT a AS key_1, c.b AS key_2, c.n / (p.n + q.n - c.n) AS tanimoto FROM c JOIN sz p ON p.s = c.a JOIN sz q ON q.s = c.b"""
)
def tanimoto_sets(spark, d):
    """Every supplier against every other by the set of its parts."""
    return L.tanimoto_pairs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("item")), "key", "item")


@query(
    f"""WITH {LIBRARY}, i AS (SELECT st, string_agg(spectrum_id::VARCHAR, ',' ORDER BY spectrum_id) AS ids FROM emb GROUP BY st), n AS (SELECT st, string_agg(nb, ',' ORDER BY r) AS neighbours, max(t) FILTER (WHERE r = 2) AS second FROM near GROUP BY st)
 SELECT i.st AS inchikey14, ids, neighbours, second, r_name AS cf_kingdom, n_name AS npc_class_results FROM i JOIN n ON n.st = i.st JOIN nation ON n_nationkey::VARCHAR = i.st JOIN region ON r_regionkey = n_regionkey"""
)
def structures_table(spark, d):
    s = library(spark, d).structures
    return s.select("inchikey14", F.array_join(F.transform("spectrum_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.transform("neighbours", lambda x: x["inchikey14"]), ",").alias("neighbours"), F.col("neighbours")[1]["tanimoto"].alias("second"), "cf_kingdom", "npc_class_results")


@query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN (props->>'$.k')::BIGINT >= 50 THEN event_type END AS a, CASE WHEN event_id % 10 = 0 THEN event_type END AS b FROM events)
 SELECT user_id, coalesce(arg_min(a, event_id) FILTER (WHERE a IS NOT NULL), '') AS a, coalesce(arg_min(b, event_id) FILTER (WHERE b IS NOT NULL), '') AS b FROM e GROUP BY user_id"""
)
def class_annotation_first(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.get_json_object("props", "$.k").cast("long") >= 50, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 10 == 0, F.col("event_type")).alias("b"))
    return A.first_annotation(e, "user_id", "event_id", ["a", "b"])


@query(
    """SELECT c_custkey AS id, r_name AS cf_kingdom, n_name AS cf_superclass, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS cf_class, c_mktsegment || '; ' || n_name AS npc_class_results, CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS npc_isglycoside
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
)
def class_json_parse(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    named = lambda x: F.struct(F.col(x).alias("name"))
    cf = F.to_json(F.struct(named("r_name").alias("kingdom"), named("n_name").alias("superclass"), F.when(F.col("c_custkey") % 3 != 0, named("c_mktsegment")).alias("class")))
    npc = F.to_json(F.struct(F.array("c_mktsegment", "n_name").alias("class_results"), (F.col("c_custkey") % 2 == 0).alias("isglycoside")))
    a, b = A.parse_classyfire(F.col("cf")), A.parse_npc(F.col("npc"))
    rows = c.select(F.col("c_custkey").alias("id"), cf.alias("cf"), npc.alias("npc"))
    return rows.select("id", *[a[k].alias(k) for k in ("cf_kingdom", "cf_superclass", "cf_class")], *[b[k].alias(k) for k in ("npc_class_results", "npc_isglycoside")])


@query("SELECT o_custkey AS key, string_agg(DISTINCT o_orderstatus || '/' || o_orderpriority, ',' ORDER BY o_orderstatus || '/' || o_orderpriority) AS variants FROM orders GROUP BY o_custkey")
def structure_variants(spark, d):
    v = A.variants(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus", "o_orderpriority"), "key", ["o_orderstatus", "o_orderpriority"])
    return v.select("key", F.array_join(F.transform("variants", lambda x: F.concat(x["o_orderstatus"], F.lit("/"), x["o_orderpriority"])), ",").alias("variants"))


@query("SELECT l_orderkey AS spectrum_id, count(*) AS n_peaks, min((l_partkey % 1200)::DOUBLE) AS first_mz, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
def mgf_roundtrip(spark, d):
    """Write all spectra as MGF and read them back."""
    path = scratch(spark, "mgf")
    write_mgf(spectra(spark, d).select("peaks", F.create_map(F.lit("scans"), F.col("spectrum_id").cast("string"), F.lit("pepmass"), F.col("precursor_mz").cast("string"), F.lit("name"), F.lit("a=b")).alias("metadata")), path)
    back = read_mgf(spark, path)
    return back.select(long(F.col("metadata")["scans"]).alias("spectrum_id"), long(F.size("peaks")).alias("n_peaks"), F.col("peaks")[0]["mz"].alias("first_mz"), F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["intensity"]).cast("long").alias("total"))


_SPECTRA_BACK = "SELECT l_orderkey AS spectrum_id, count(*) AS n_peaks, min((l_partkey % 1200)::DOUBLE) AS first_mz, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY l_orderkey"


def _summary(back):
    first, total = F.col("peaks")[0]["mz"], F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["intensity"]).cast("long")
    return back.select(long(F.col("metadata")["scans"]).alias("spectrum_id"), long(F.size("peaks")).alias("n_peaks"), first.alias("first_mz"), total.alias("total"))


@query(_SPECTRA_BACK)
def read_msp_files(spark, d):
    """All spectra from MSP text with CR LF, half of the records without an empty line after them."""
    path = scratch(spark, "msp")
    lines = F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string")))
    head = F.array(F.lit("Name: a:b; 1"), F.concat(F.lit("Scans: "), F.col("spectrum_id").cast("string")), F.concat(F.lit("Num Peaks: "), F.size("peaks").cast("string")))
    end = F.when(F.col("spectrum_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))
    spectra(spark, d).select(F.concat(F.array_join(F.concat(head, lines), "\r\n"), end).alias("value")).write.text(path)
    return _summary(read_msp(spark, path))


@query(_SPECTRA_BACK)
def read_gnps_json_files(spark, d):
    """All spectra from files that hold arrays of objects."""
    path = scratch(spark, "json")
    pairs = F.to_json(F.transform("peaks", lambda p: F.array(p["mz"], p["intensity"])))
    record = F.to_json(F.struct(F.col("spectrum_id").cast("string").alias("scans"), pairs.alias("peaks_json"), F.lit('a "b" { ] c').alias("note")))
    rows = spectra(spark, d).select(F.floor(F.col("spectrum_id") / 5000).alias("file"), record.alias("r"))
    files = rows.groupBy("file").agg(F.array_join(F.collect_list("r"), ",\n").alias("r")).select(F.concat(F.lit("["), "r", F.lit("]")).alias("value"))
    files.repartition(8).write.option("maxRecordsPerFile", 1).text(path)  # a test's files of 5000 records each
    return _summary(read_gnps_json(spark, path))
