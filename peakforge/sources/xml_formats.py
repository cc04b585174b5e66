"""mzML and mzXML readers: Spark's XML source, and decoding of the packed arrays by a Pandas UDF."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CV = "array<struct<_accession:string,_value:string>>"
MZML = f"""_index long, _id string, cvParam {_CV},
 scanList struct<scan:array<struct<cvParam:{_CV}>>>,
 precursorList struct<precursor:array<struct<selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>>>>,
 binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},binary:string>>>"""
MZXML = """_num long, _msLevel int, _polarity string, _retentionTime string,
 precursorMz struct<_VALUE:double,_precursorIntensity:double>,
 peaks struct<_VALUE:string,_precision:int,_compressionType:string>"""
# Terms of the PSI-MS vocabulary.
MS_LEVEL, SELECTED_MZ, SCAN_TIME = "MS:1000511", "MS:1000744", "MS:1000016"
NEGATIVE, POSITIVE = "MS:1000129", "MS:1000130"
MZ_ARRAY, INTENSITY_ARRAY, ZLIB, FLOAT64 = "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000523"


def unpack(text: str | None, bits: int, packed: bool, order: str = "<") -> list[float]:
    """Numbers of a base64 text, ``packed`` by zlib or not."""
    if not text:
        return []
    raw = base64.b64decode(text)
    return np.frombuffer(zlib.decompress(raw) if packed else raw, f"{order}f{bits // 8}").astype(float).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unpack_little(text: pd.Series, bits: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([unpack(t, b, p) for t, b, p in zip(text, bits, packed, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unpack_big(text: pd.Series, bits: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([unpack(t, b, p, ">") for t, b, p in zip(text, bits, packed, strict=True)], dtype=object)


def _value(params: Column, accession: str) -> Column:
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))["_value"]


def _has(params: Column, accession: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"] == accession), F.lit(False))


def _entries(**values: Column) -> Column:
    given = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(given)


def _zipped(mz: Column, intensity: Column) -> Column:
    return F.array_sort(F.zip_with(mz, intensity, lambda m, i: F.struct(m.alias("mz"), i.alias("intensity"))))


def read_mzml(spark: SparkSession, path: str, ms_level: int = 2) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(MZML).load(path).withColumn("source_file", F.input_file_name())
    params, arrays = F.col("cvParam"), F.col("binaryDataArrayList.binaryDataArray")
    raw = raw.filter(_value(params, MS_LEVEL).cast("int") == ms_level)

    def numbers(which: str) -> Column:
        a = F.get(F.filter(arrays, lambda x: F.exists(x["cvParam"], lambda p: p["_accession"] == which)), F.lit(0))
        return _unpack_little(a["binary"], F.when(_has(a["cvParam"], FLOAT64), 64).otherwise(32), _has(a["cvParam"], ZLIB))

    ion = F.get(F.get(F.col("precursorList.precursor"), F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    scan = F.get(F.col("scanList.scan"), F.lit(0))["cvParam"]
    mode = F.when(_has(params, POSITIVE), "positive").when(_has(params, NEGATIVE), "negative")
    meta = _entries(scan_id=F.col("_id"), precursor_mz=_value(ion, SELECTED_MZ), retention_time=_value(scan, SCAN_TIME), ionmode=mode)
    return raw.select("source_file", F.col("_index").alias("record_no"), _zipped(numbers(MZ_ARRAY), numbers(INTENSITY_ARRAY)).alias("peaks"), meta.alias("metadata"))


def read_mzxml(spark: SparkSession, path: str, ms_level: int = 2) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "scan").schema(MZXML).load(path).withColumn("source_file", F.input_file_name())
    raw = raw.filter(F.col("_msLevel") == ms_level)
    flat = _unpack_big(F.col("peaks._VALUE"), F.coalesce("peaks._precision", F.lit(32)), F.coalesce(F.lower("peaks._compressionType") == "zlib", F.lit(False)))
    at = lambda k: F.filter(F.col("__x"), lambda x, i: i % 2 == k)
    mode = F.when(F.col("_polarity") == "+", "positive").when(F.col("_polarity") == "-", "negative")
    seconds = F.regexp_extract("_retentionTime", r"PT([0-9.]+)S", 1).try_cast("double")
    meta = _entries(scan_id=F.col("_num"), precursor_mz=F.col("precursorMz._VALUE"), retention_time=seconds, ionmode=mode)
    return raw.withColumn("__x", flat).select("source_file", F.col("_num").alias("record_no"), _zipped(at(0), at(1)).alias("peaks"), meta.alias("metadata"))
