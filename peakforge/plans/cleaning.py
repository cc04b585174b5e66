"""Cleaning queries."""

from pyspark.sql import functions as F

from ..functions import peaks as P
from ..operators import cleaning as C
from .registry import PEAKS, flat, long, peaks, query, rounded, spectra, table


@query(f"WITH {PEAKS} SELECT spectrum_id, mz, intensity / max(intensity) OVER (PARTITION BY spectrum_id) AS intensity FROM pk")
def normalize_peaks(spark, d):
    return flat(peaks(spark, d).withColumn("peaks", P.normalise(F.col("peaks"))))


@query(f"WITH {PEAKS}, n AS (SELECT spectrum_id, mz, intensity / max(intensity) OVER (PARTITION BY spectrum_id) AS intensity FROM pk) SELECT * FROM n WHERE intensity BETWEEN 0.2 AND 1")
def filter_relative_intensity(spark, d):
    return flat(peaks(spark, d).withColumn("peaks", P.keep_intensity(P.normalise(F.col("peaks")), 0.2)))


@query(f"WITH {PEAKS} SELECT * FROM pk WHERE mz BETWEEN 0 AND 1000")
def filter_mz_range(spark, d):
    return flat(peaks(spark, d).withColumn("peaks", P.keep_mz(F.col("peaks"))))


@query(f"WITH {PEAKS} SELECT spectrum_id, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz) AS r FROM pk) WHERE r <= 4")
def reduce_to_n_peaks(spark, d):
    return flat(peaks(spark, d).withColumn("peaks", P.keep_largest(F.col("peaks"), 4)))


@query(f"WITH {PEAKS} SELECT spectrum_id, count(*) AS n_peaks FROM pk GROUP BY spectrum_id HAVING count(*) >= 3")
def min_peaks(spark, d):
    return peaks(spark, d).filter(F.size("peaks") >= 3).select("spectrum_id", long(F.size("peaks")).alias("n_peaks"))


@query(f"WITH {PEAKS}, a AS (SELECT * FROM pk WHERE mz >= 10) SELECT spectrum_id, count(*) AS n_peaks FROM a GROUP BY spectrum_id HAVING count(*) FILTER (WHERE mz < 1000) >= 5")
def minimal_processing(spark, d):
    return C.minimal_processing(peaks(spark, d)).select("spectrum_id", long(F.size("peaks")).alias("n_peaks"))


@query(
    f"""WITH {PEAKS}, n AS (SELECT spectrum_id, mz, intensity / max(intensity) OVER (PARTITION BY spectrum_id) AS intensity FROM pk), f AS (SELECT * FROM n WHERE mz BETWEEN 0 AND 1000),
 r AS (SELECT f.*, o_custkey % 20 AS mass, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz) AS pos FROM f JOIN orders ON o_orderkey = spectrum_id)
 SELECT spectrum_id, count(*) AS n_peaks FROM r WHERE pos <= least(500, greatest(5, ceil(mass * 0.5))) GROUP BY spectrum_id HAVING count(*) >= 5"""
)
def word_processing(spark, d):
    s = spectra(spark, d).withColumn("parent_mass", (F.col("structure") % 20).cast("double"))
    return C.word_processing(s).select("spectrum_id", long(F.size("peaks")).alias("n_peaks"))


@query(f"WITH {PEAKS} SELECT o_orderkey AS spectrum_id, count(mz) AS n_peaks FROM orders JOIN pk ON spectrum_id = o_orderkey GROUP BY o_orderkey")
def drop_empty_spectra(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum_id")).join(peaks(spark, d), "spectrum_id", "left")
    none = F.array().cast("array<struct<mz:double,intensity:double>>")
    return C.drop_empty(o.withColumn("peaks", F.coalesce("peaks", none))).select("spectrum_id", long(F.size("peaks")).alias("n_peaks"))


@query("SELECT event_id AS spectrum_id, value AS precursor_mz, CASE WHEN event_type = 'error' THEN NULL ELSE trim(event_type) END AS compound_name, user_id::DOUBLE AS retention_time FROM events WHERE event_id % 11 <> 0")
def clean_metadata(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("event_id").alias("spectrum_id"), F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("precursor_mz"),
                   F.when(F.col("event_type") == "error", " N/A ").otherwise(F.concat("event_type", F.lit("; "))).alias("compound_name"), F.concat(F.col("user_id").cast("string"), F.lit(" min")).alias("retention_time"))
    return C.clean_metadata(raw)


@query("SELECT o_orderkey AS spectrum_id, o_totalprice AS precursor_mz FROM orders WHERE o_orderstatus = 'O'")
def ionmode_filter(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum_id"), F.col("o_totalprice").alias("precursor_mz"), F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative").alias("ionmode"))
    return C.keep_ion_mode(o, "positive").drop("ionmode")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def ionmode_assert(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.when(F.col("o_orderstatus") == "O", "positive").alias("ionmode"))
    return C.check_ion_mode(o, "positive").agg(F.count(F.lit(1)).alias("n"), F.max("ionmode").alias("m")).select("n")


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'positive' ELSE 'negative' END AS ionmode FROM orders WHERE o_orderstatus IN ('O', 'F') ORDER BY o_orderkey LIMIT 1")
def ionmode_probe(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum_id"), F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative").alias("ionmode"))
    return C.probe_ion_mode(o)


@query("SELECT event_id AS spectrum_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id % 4 END::BIGINT AS charge, 1::BIGINT AS all_charges FROM events")
def charge_fill(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("spectrum_id"), F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 4).cast("int").alias("charge"))
    out = C.fill_charge(e).withColumn("all_charges", F.col("charge"))
    return C.fill_charge(out, change_all=True, column="all_charges").select("spectrum_id", long("charge").alias("charge"), long("all_charges").alias("all_charges"))


_ANNOTATED = """a AS (SELECT c_nationkey, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS annotated FROM customer)"""


def _annotated(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_nationkey", key.alias("id"), F.col("c_acctbal").alias("precursor_mz"),
        F.when(key % 5 == 0, "N/A").otherwise(F.concat(F.lit("C"), "c_mktsegment")).alias("smiles"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("InChI=1S/"), "c_name")).alias("inchi"),
        F.when(key % 2 == 0, "AAAAAAAAAAAAAA-BBBBBBBBBB-N").otherwise("bad key").alias("inchikey"),
    )


@query(f"WITH {_ANNOTATED} SELECT c_nationkey::BIGINT AS nation, count(*) FILTER (WHERE annotated) AS n_annotated, count(*) FILTER (WHERE NOT annotated) AS n_rest FROM a GROUP BY c_nationkey")
def annotated_split(spark, d):
    yes, no = C.split_annotated(C.harmonise_annotation(_annotated(spark, d)))
    both = yes.select("c_nationkey", F.lit(1).alias("y")).unionAll(no.select("c_nationkey", F.lit(0).alias("y")))
    return both.groupBy(long("c_nationkey").alias("nation")).agg(F.count_if(F.col("y") == 1).alias("n_annotated"), F.count_if(F.col("y") == 0).alias("n_rest"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'InChI=1S/' || c_name END AS inchi, CASE WHEN c_custkey % 4 = 1 THEN 'AAAAAAAAAAAAAA-BBBBBBBBBB-N' END AS inchikey, CASE WHEN c_custkey % 4 = 2 THEN c_mktsegment END AS smiles FROM customer")
def repair_annotation(spark, d):
    key = F.col("c_custkey") % 4
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(key == 1, "AAAAAAAAAAAAAA-BBBBBBBBBB-N").otherwise("n/a").alias("inchi"), F.when(key == 2, F.col("c_mktsegment")).alias("inchikey"), F.when(key == 0, F.concat(F.lit("InChI=1S/"), "c_name")).otherwise("").alias("smiles"))
    return C.harmonise_annotation(c).select("id", "inchi", "inchikey", "smiles")


@query(
    f"""WITH {PEAKS}, n AS (SELECT spectrum_id, mz, intensity / max(intensity) OVER (PARTITION BY spectrum_id) AS intensity FROM pk), f AS (SELECT * FROM n WHERE intensity BETWEEN 0.001 AND 1 AND mz BETWEEN 0 AND 1000)
 SELECT spectrum_id, any_value(o_orderpriority) AS compound_name, any_value(o_totalprice) AS precursor_mz, count(*) AS n_peaks, min(intensity) AS least, max(mz) AS top FROM f JOIN orders ON o_orderkey = spectrum_id
 WHERE o_orderstatus = 'O' GROUP BY spectrum_id HAVING count(*) >= 3"""
)
def clean_pipeline(spark, d):
    s = spectra(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("smiles", "inchi", "inchikey")})
    _, rest = C.clean_and_split(s, "positive")
    return rest.select("spectrum_id", "compound_name", "precursor_mz", long(F.size("peaks")).alias("n_peaks"), F.array_min(F.transform("peaks", lambda p: p["intensity"])).alias("least"), F.array_max(F.transform("peaks", lambda p: p["mz"])).alias("top"))


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def strip_names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.strip_name(F.concat(F.lit("; "), "p_name", F.lit("; ;"))).alias("name"))


@query("SELECT CASE WHEN contains(lower(o_orderpriority), 'high') THEN 'positive' WHEN contains(lower(o_orderpriority), 'low') THEN 'negative' ELSE 'unknown' END AS mode, count(*) AS n FROM orders GROUP BY 1")
def instance_split(spark, d):
    return table(spark, d, "orders").groupBy(C.class_of(F.col("o_orderpriority"), "high", "low").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = "'peak@' || (floor(mz * 100 + 0.5) / 100)::DECIMAL(12, 2)::VARCHAR"


@query(f"WITH {PEAKS} SELECT spectrum_id, {_WORDS} AS word FROM pk UNION ALL SELECT spectrum_id, 'loss@' || (floor((o_totalprice / 100 - mz) * 100 + 0.5) / 100)::DECIMAL(12, 2)::VARCHAR FROM pk JOIN orders ON o_orderkey = spectrum_id WHERE o_totalprice / 100 - mz BETWEEN 5 AND 200")
def peak_words(spark, d):
    s = spectra(spark, d)
    words = F.concat(P.peak_words(F.col("peaks")), P.loss_words(F.col("peaks"), F.col("precursor_mz") / 100))
    # every order has a spectrum only if it has lines, and every line belongs to an order
    return s.select("spectrum_id", F.explode(words).alias("word"))


@query(
    f"""WITH {PEAKS}, v AS (SELECT 'peak@' || vec_id::DECIMAL(12, 2)::VARCHAR AS word, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
 w AS (SELECT spectrum_id, {_WORDS} AS word, intensity FROM pk) SELECT spectrum_id, dim::BIGINT AS dim, round(sum(intensity * x), 4) AS x FROM w JOIN v USING (word) GROUP BY spectrum_id, dim"""
)
def document_embedding(spark, d):
    from ..operators.model import document_embedding as embed

    docs = peaks(spark, d).select("spectrum_id", P.peak_words(F.col("peaks")).alias("words"), F.transform("peaks", lambda p: p["intensity"]).alias("weights"))
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("peak@"), F.col("vec_id").cast("decimal(12,2)").cast("string")).alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    return embed(docs, vectors, "spectrum_id").select("spectrum_id", F.posexplode("embedding").alias("dim", "x")).select("spectrum_id", long("dim").alias("dim"), rounded("x", 4).alias("x"))
