"""Loading spectra by file extension, folders, libraries, and older library files."""

from __future__ import annotations

import ast
import json
import os
import sqlite3
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import packed
from ..operators.util import files_of
from ..schema import PROMOTED
from .text_formats import read_gnps_json, read_mgf, read_msp
from .xml_formats import read_mzml, read_mzxml

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".mgf": read_mgf, ".msp": read_msp, ".json": read_gnps_json, ".mzml": read_mzml, ".mzxml": read_mzxml}


def promote(df: DataFrame) -> DataFrame:
    """Typed columns for the usual metadata keys; the map stays."""
    from ..operators.cleaning import number

    cols = {k: (number(F.col("metadata")[k]).cast(t) if t in ("double", "int") else F.col("metadata")[k]) for k, t in PROMOTED.items()}
    return df.withColumns(cols)


def load_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Read a spectrum file by its extension, case ignored."""
    extension = os.path.splitext(path)[1].lower()
    if extension == ".usi":
        raise NotImplementedError("a universal spectrum identifier is looked up over the network, which is not supported")
    if extension not in READERS:
        raise ValueError(f"unknown spectrum file type {extension!r}; known are {sorted(READERS)}")
    return promote(READERS[extension](spark, path))


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Regular files of a folder, sorted by name, on any file system that Spark reads; folders in it are not entered."""
    return files_of(spark, folder)


def spectrum_files(spark: SparkSession, folder: str, say: Callable[[str], None] = print) -> list[str]:
    """Names of the spectrum files of a folder; other files are named and skipped."""
    found = []
    for name in files_in(spark, folder):
        if os.path.splitext(name)[1].lower() in READERS:
            found.append(name)
        else:
            say(f"skipped, not a spectrum file: {name}")
    if not found:
        say(f"no spectrum files in {folder}")
    return found


def load_folder(spark: SparkSession, folder: str, say: Callable[[str], None] = print) -> DataFrame | None:
    """All spectrum files of a folder as one frame with ``source_file``; None if there is none."""
    found = [load_spectra(spark, f"{folder.rstrip('/')}/{name}") for name in spectrum_files(spark, folder, say)]
    return reduce(DataFrame.unionByName, found) if found else None


@dataclass(frozen=True)
class LibraryPaths:
    sqlite: str | None = None
    word_model: str | None = None
    network: str | None = None
    forest: str | None = None
    second_embeddings: str | None = None
    embeddings: str | None = None


#: Suffixes of library files.
SUFFIXES = {"sqlite": ".sqlite", "word_model": ".model", "network": ".pt", "forest": ".onnx", "second_embeddings": "s2v_embeddings.parquet", "embeddings": "ms2ds_embeddings.parquet"}


def find_library_files(names: list[str], wanted: list[str] | None = None) -> LibraryPaths:
    """Library files by suffix. Two of one kind, any pickle, or no .onnx (if wanted) is an error; others may be missing."""
    out: dict[str, str] = {}
    for name in names:
        if name.endswith(".pickle"):
            raise ValueError(f"pickled libraries are not supported: {name}")
        for kind, suffix in SUFFIXES.items():
            if name.endswith(suffix) and (wanted is None or kind in wanted):
                if kind in out:
                    raise ValueError(f"two files of kind {suffix}: {out[kind]}, {name}")
                out[kind] = name
    if (wanted is None or "forest" in wanted) and "forest" not in out:
        raise FileNotFoundError("no .onnx model among the library files")
    return LibraryPaths(**out)


def read_embeddings(spark: SparkSession, path: str, spectrum_id: str = "spectrum_id") -> DataFrame:
    """(spectrum_id, embedding); files with one column per dimension and the id as index are packed into an array."""
    df = spark.read.parquet(path)
    if "embedding" in df.columns:
        return df
    index = next((c for c in df.columns if c in (spectrum_id, "__index_level_0__", "index")), None)
    dims = sorted((c for c in df.columns if c != index), key=lambda c: int(c) if c.isdigit() else 0)
    if index is None:
        raise ValueError(f"no id column in {path}")
    return packed(df.withColumnRenamed(index, spectrum_id), dims)


def import_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spectra, structures) of an older SQLite library; values written as Python literals become arrays and maps."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        db.row_factory = sqlite3.Row
        spectra = [(r["spectrumid"], {k: None if v is None else str(v) for k, v in ast.literal_eval(r["metadata"]).items()}, r["precursor_mz"]) for r in db.execute("select spectrumid, metadata, precursor_mz from spectrum_data")]
        rows = [dict(r) for r in db.execute("select * from inchikeys")]
    fixed = ("inchikey", "spectrum_ids_belonging_to_inchikey14", "closest_related_inchikeys")
    classes = [c for c in rows[0] if c not in fixed] if rows else []
    made = [(r[fixed[0]], ast.literal_eval(r[fixed[1]]), [(k, float(t)) for k, t in ast.literal_eval(r[fixed[2]])], *[r[c] for c in classes]) for r in rows]
    a = spark.createDataFrame(spectra, "spectrum_id long, metadata map<string,string>, precursor_mz double")
    b = spark.createDataFrame(made, "inchikey14 string, spectrum_ids array<long>, neighbours array<struct<inchikey14:string,tanimoto:double>>" + "".join(f", `{c}` string" for c in classes))
    return a.withColumns({k: F.col("metadata")[k].try_cast(t) for k, t in PROMOTED.items() if k != "precursor_mz"}).withColumn("inchikey14", F.substring("inchikey", 1, 14)), b


def load_json(path: str):
    with open(path) as f:
        return json.load(f)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Search results from CSV, numbers as double."""
    df = spark.read.csv(path, header=True)
    numbers = [c for c in df.columns if c.startswith("precursor_mz") or c.endswith("_prediction")]
    return df.withColumns({**{c: F.col(c).cast("double") for c in numbers}, "query_spectrum_nr": F.col("query_spectrum_nr").cast("long")})
