"""Schemas of the engine's tables and the order of result columns."""

from __future__ import annotations

from pyspark.sql import types as T

PEAK = T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])
PEAKS = T.ArrayType(PEAK)

SPECTRUM = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("record_no", T.LongType()),
        T.StructField("peaks", PEAKS),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Metadata keys that become typed columns, with their types.
PROMOTED = {
    "precursor_mz": "double",
    "charge": "int",
    "ionmode": "string",
    "adduct": "string",
    "parent_mass": "double",
    "compound_name": "string",
    "smiles": "string",
    "inchi": "string",
    "inchikey": "string",
    "retention_time": "double",
    "retention_index": "double",
    "feature_id": "string",
}

#: Names and order of class and result columns, which result files have.
CLASS_COLUMNS = (
    "cf_kingdom", "cf_superclass", "cf_class", "cf_subclass", "cf_direct_parent",
    "npc_class_results", "npc_superclass_results", "npc_pathway_results", "npc_isglycoside",
)
#: npc_isglycoside is stored with a library but is no output column.
OUTPUT_CLASSES = CLASS_COLUMNS[:-1]
RESULT_COLUMNS = (
    "query_spectrum_nr", "model_prediction", "precursor_mz_difference", "precursor_mz_query_spectrum",
    "precursor_mz_analog", "inchikey", "analog_compound_name", "smiles",
)


def output_columns(metadata=(), scores=(), classes: bool = True) -> list[str]:
    """Order of result columns: fixed ones, additional metadata, additional scores, compound classes."""
    return [*RESULT_COLUMNS, *metadata, *scores, *(OUTPUT_CLASSES if classes else ())]
