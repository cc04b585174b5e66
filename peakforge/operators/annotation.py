"""Compound classes: parsing of class records and choosing one per structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMED = "struct<name:string>"
CLASSYFIRE = f"kingdom {_NAMED}, superclass {_NAMED}, class {_NAMED}, subclass {_NAMED}, direct_parent {_NAMED}"
NPC = "class_results array<string>, superclass_results array<string>, pathway_results array<string>, isglycoside boolean"


def parse_classyfire(json: Column) -> dict[str, Column]:
    """The names of the five levels; null where the record or a level is missing."""
    r = F.from_json(json, CLASSYFIRE)
    levels = {"cf_kingdom": "kingdom", "cf_superclass": "superclass", "cf_class": "class", "cf_subclass": "subclass", "cf_direct_parent": "direct_parent"}
    return {c: r[level]["name"] for c, level in levels.items()}


def parse_npc(json: Column) -> dict[str, Column]:
    """Lists joined by ``; ``, the flag as ``True`` or ``False``."""
    r = F.from_json(json, NPC)
    out = {f"npc_{f}": F.array_join(r[f], "; ") for f in ("class_results", "superclass_results", "pathway_results")}
    return out | {"npc_isglycoside": F.when(r["isglycoside"], "True").when(~r["isglycoside"], "False")}


def first_annotation(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the first non-null value of each column in the given order, an empty text where there is none."""
    first = [F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))), F.lit("")).alias(c) for c in columns]
    return df.groupBy(key).agg(*first)


def variants(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The distinct combinations of ``columns`` per key, sorted, as one array."""
    return df.select(key, *columns).distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("variants"))
