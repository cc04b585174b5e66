"""Writers: result CSV, parquet, JSON and MGF."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import formatted
from ..operators.util import exists, stable


def free_name(path: str, spark: SparkSession | None = None) -> str:
    """``path``, or with (1), (2), ... before the extension if it exists; with ``spark`` on any file system it reads."""
    there = (lambda p: exists(spark, p)) if spark else os.path.exists
    stem, extension = os.path.splitext(path)
    out, n = path, 0
    while there(out):
        n += 1
        out = f"{stem}({n}){extension}"
    return out


def write_results(results: DataFrame, path: str, single: bool = False, names: dict[str, str] | None = None) -> None:
    """Result rows as CSV with a header, four decimals, in order of query and rank; ``single``: one file, for small results.

    ``names``: other header names for columns, where readers of the files expect them.
    """
    out = results.coalesce(1) if single else results.repartitionByRange("query_spectrum_nr")
    out = formatted(out.sortWithinPartitions("query_spectrum_nr", "rank").drop("rank")).withColumnsRenamed(names or {})
    out.write.mode("errorifexists").csv(path, header=True, emptyValue="")


def write_parquet(df: DataFrame, path: str) -> None:
    """Fails if ``path`` exists. Column names become text."""
    df.toDF(*map(str, df.columns)).write.mode("errorifexists").parquet(path)


def write_json(data: DataFrame | object, path: str) -> None:
    """A frame as JSON lines, other data as one document; fails if ``path`` exists."""
    if isinstance(data, DataFrame):
        data.write.mode("errorifexists").json(path)
        return
    with open(path, "x") as f:
        json.dump(data, f)


def mgf_records(spectra: DataFrame) -> DataFrame:
    """One text value per spectrum: the record in MGF, metadata in order of its keys."""
    meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.upper(e["key"]), F.lit("="), F.coalesce(e["value"], F.lit(""))))
    peaks = F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string")))
    return spectra.select(F.concat_ws("\n", F.lit("BEGIN IONS"), meta, peaks, F.lit("END IONS\n")).alias("value"))


def write_mgf(spectra: DataFrame, path: str) -> None:
    mgf_records(spectra).write.mode("errorifexists").text(path)


def file_name(column: str = "source_file") -> Column:
    """The last part of a path."""
    return F.regexp_extract(column, r"([^/]+)/*$", 1)


def write_by_file(results: DataFrame, folder: str, files: list[str], column: str = "source_file") -> list[str]:
    """Results of several input files, a CSV for each of ``files``, also for one without results: ``name.csv``, or with a
    number if that exists. Returns the paths."""
    spark = results.sparkSession
    named = stable(results.withColumn(column, file_name(column)), "results")
    out = []
    for name in files:
        out.append(free_name(f"{folder.rstrip('/')}/{os.path.splitext(name)[0]}.csv", spark))
        write_results(named.filter(F.col(column) == name).drop(column), out[-1], single=True)
    return out


def write_classes(classes: DataFrame, path: str) -> None:
    classes.write.mode("errorifexists").csv(path, header=True, sep="\t")
