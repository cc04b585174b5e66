"""MGF, MSP and GNPS-style JSON readers as DataFrame expressions.

Records come from Spark's text source with the record mark as line separator, so that large files are split over tasks.
``record_no`` is the 0-based position in the file: the order of file blocks and of records within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.util import stable

NUMBER = r"[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?"
PEAK_LINE = rf"^\s*{NUMBER}[\s,;]+{NUMBER}"
#: Other names of metadata keys.
SYNONYMS = {"pepmass": "precursor_mz", "precursormz": "precursor_mz", "exactmass": "parent_mass", "ion_mode": "ionmode", "name": "compound_name", "inchi_key": "inchikey", "rtinseconds": "retention_time", "retentiontime": "retention_time", "precursortype": "adduct", "precursor_type": "adduct"}


def _numbered(raw: DataFrame) -> DataFrame:
    """(source_file, record_no, value): the position of each record in its file, by the order of file blocks and of records
    within them. Counts per block are summed; no file is sorted in one task.

    ``raw``: value, source_file, __block (where the file's part begins), __at (rising within a part).
    """
    raw = stable(raw, "records")
    counts = raw.groupBy("source_file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = Window.partitionBy("source_file", "__block").orderBy("__at")
    out = raw.join(counts.select("source_file", "__block", "__before"), ["source_file", "__block"])
    return out.select("source_file", (F.col("__before") + F.row_number().over(within) - 1).cast("long").alias("record_no"), "value")


def _source(spark: SparkSession, path: str, separator: str) -> DataFrame:
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))


def _first_of_each(entries: Column) -> Column:
    """A map from structs (key, value); of repeated keys the first counts."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def _metadata(lines: Column, mark: str) -> Column:
    """Map of lower-case keys from ``key<mark>value`` lines; only the first mark of a line splits it."""
    own = F.filter(lines, lambda x: x.rlike(rf"^\s*[A-Za-z][^{mark}]*{mark}"))
    entry = lambda x: F.struct(F.regexp_replace(F.lower(F.trim(F.split(x, mark, 2)[0])), r"[\s#]+", "_").alias("key"), F.trim(F.split(x, mark, 2)[1]).alias("value"))
    return _first_of_each(F.transform(own, entry))


def _peaks(lines: Column) -> Column:
    parts = lambda x: F.split(F.trim(x), r"[\s,;]+")
    found = F.transform(F.filter(lines, lambda x: x.rlike(PEAK_LINE)), lambda x: F.struct(parts(x)[0].cast("double").alias("mz"), parts(x)[1].cast("double").alias("intensity")))
    return F.array_sort(found)


def _with_synonyms(df: DataFrame) -> DataFrame:
    """Known synonyms also under the usual key, where that is absent; a precursor is the first number of its value."""
    given = F.map_entries("metadata")
    more = F.transform(F.filter(given, lambda e: e["key"].isin(*SYNONYMS)), lambda e: F.struct(F.coalesce(*[F.when(e["key"] == a, F.lit(b)) for a, b in SYNONYMS.items()]).alias("key"), e["value"].alias("value")))
    return df.withColumn("metadata", _first_of_each(F.concat(given, more)))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    records = _numbered(_source(spark, path, "BEGIN IONS").filter(F.contains("value", F.lit("END IONS"))))
    body = F.split(F.split("value", "END IONS")[0], r"\r?\n")
    out = records.withColumn("__l", body).select("source_file", "record_no", _peaks(F.col("__l")).alias("peaks"), _metadata(F.col("__l"), "=").alias("metadata"))
    return _with_synonyms(out)


#: A line that begins an MSP record: its name, which comes first.
MSP_FIRST = r"(?i)^\s*NAME\s*:"


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``name: value`` lines, then peaks, several to a line if separated by ``;``. An empty line or a Name line
    ends the record before; lines may end in CR LF.

    The file is read by lines, which are numbered over the whole file; a record is the lines from one beginning to the next.
    """
    lines = _source(spark, path, "\n").select(F.regexp_replace("value", r"\r$", "").alias("value"), "source_file", "__block", "__at")
    lines = stable(_numbered(lines).withColumnRenamed("record_no", "__line"), "lines")
    parts = lines.withColumn("__part", F.floor(F.col("__line") / PART_LINES))
    empty = F.trim(F.regexp_replace("value", r"\s+", " ")) == ""
    # Where a record begins: a Name line, or the first line with text in the file or after an empty one.
    order = Window.partitionBy("source_file", "__part").orderBy("__line")
    last = lines.filter(F.col("__line") % PART_LINES == PART_LINES - 1).select("source_file", (F.floor(F.col("__line") / PART_LINES) + 1).alias("__part"), empty.alias("__last"))
    parts = parts.join(last, ["source_file", "__part"], "left")
    after = F.coalesce(F.lag(empty).over(order), F.col("__last"), F.lit(True))
    marked = stable(parts.withColumn("__begins", (~empty & (after | F.col("value").rlike(MSP_FIRST))).cast("long")).filter(~empty).drop("__last"), "lines")
    counts = marked.groupBy("source_file", "__part").agg(F.sum("__begins").alias("__n"))
    before = Window.partitionBy("source_file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per PART_LINES lines
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    marked = marked.join(counts, ["source_file", "__part"])
    marked = marked.withColumn("record_no", (F.col("__before") + F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    records = marked.groupBy("source_file", "record_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("__line", "value"))), lambda x: x["value"]).alias("__l"))
    # Only peak lines are cut at ``;``: metadata values may hold any.
    peak = lambda x: x.rlike(PEAK_LINE)
    cut = F.flatten(F.transform(F.filter("__l", peak), lambda x: F.split(x, ";")))
    out = records.select("source_file", "record_no", _peaks(cut).alias("peaks"), _metadata(F.filter("__l", lambda x: ~peak(x)), ":").alias("metadata"))
    return _with_synonyms(out)


#: Lines of a file that one task numbers.
PART_LINES = 1 << 16


def read_gnps_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects; peaks as ``peaks_json`` (text) or ``peaks`` (lists of two numbers).

    Records are cut where one object of the array ends and the next begins, so a large file is split over tasks. The cut
    needs a brace, a comma and a brace between objects, with white space at most, as such files have. Objects may hold
    objects, but no lists of objects; a record that does not parse is an error, never left out.
    """
    raw = _source(spark, path, "}").filter(~F.col("value").rlike(r"^[\s\ufeff]*(\[\s*)?\][\s]*$"))  # not the end of the array
    pieces = _numbered(raw)
    # A piece opens a record if it begins with [ or , and a brace; others go on with the record before.
    opens = F.col("value").rlike(r"^[\s\ufeff]*[\[,]\s*\{") | F.col("value").rlike(r"^[\s\ufeff]*\{")
    part = F.floor(F.col("record_no") / PART_LINES)
    marked = stable(pieces.select("source_file", F.col("record_no").alias("__piece"), part.alias("__part"), "value", opens.cast("long").alias("__begins")), "pieces")
    counts = marked.groupBy("source_file", "__part").agg(F.sum("__begins").alias("__n"))
    before = Window.partitionBy("source_file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per PART_LINES pieces
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    order = Window.partitionBy("source_file", "__part").orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.join(counts, ["source_file", "__part"]).withColumn("record_no", (F.col("__before") + F.sum("__begins").over(order) - 1).cast("long"))
    texts = marked.groupBy("source_file", "record_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__piece", "value"))), lambda x: x["value"]), "}").alias("t"))
    body = F.concat(F.regexp_replace("t", r"^[\s\ufeff]*[\[,]?\s*", ""), F.lit("}"))
    rows = texts.select("source_file", "record_no", F.from_json(body, "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    rows = rows.select("source_file", "record_no", F.transform_keys("m", lambda k, v: F.lower(k)).alias("m"))
    pairs = F.from_json(F.coalesce(F.col("m")["peaks_json"], F.col("m")["peaks"]), "array<array<double>>")
    peaks = F.array_sort(F.transform(pairs, lambda p: F.struct(p[0].alias("mz"), p[1].alias("intensity"))))
    rows = rows.select("source_file", "record_no", F.coalesce(peaks, F.array().cast("array<struct<mz:double,intensity:double>>")).alias("peaks"), F.map_filter("m", lambda k, v: ~k.isin("peaks", "peaks_json")).alias("metadata"))
    return _with_synonyms(rows)
