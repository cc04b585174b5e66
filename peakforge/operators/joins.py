"""Joins: bands, lookups, semi and anti splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Pairs with |left - right| <= tolerance, both ends included, as an equi-join on bins of that width.

    The left row meets the bins below, at and above its own; a right row lies in one bin, so no pair comes twice. Column
    names must differ. ``how``: inner or left.
    """
    width = tolerance * (1 + 1e-9) or 1.0
    l = left.withColumn("__bins", F.array(*[(F.floor(F.col(left_value) / width) + d).cast("long") for d in (-1, 0, 1)]))
    l = l.withColumn("__bin", F.explode_outer("__bins")).drop("__bins") if how == "left" else l.withColumn("__bin", F.explode("__bins")).drop("__bins")
    r = right.withColumn("__bin", F.floor(F.col(right_value) / width).cast("long"))
    near = F.abs(F.col(left_value) - F.col(right_value)) <= tolerance
    pairs = l.join(r, "__bin").filter(near).drop("__bin")
    if how == "inner":
        return pairs
    # Whether a row has a partner depends on its value alone; a null value has none.
    unmatched = left.join(pairs.select(left_value).distinct(), left_value, "left_anti").select(left.columns)
    return pairs.unionByName(unmatched, allowMissingColumns=True)


def ppm_window(mass: Column, ppm: float) -> tuple[Column, Column]:
    """(low, high) of mass +- mass * ppm / 1e6."""
    return mass - mass * ppm / 1e6, mass + mass * ppm / 1e6


def adduct_windows(mass: Column, ppm: float, shift: float = 1.0078) -> Column:
    """Array of struct(low, high): ppm windows about a mass, and about it with the mass of a hydrogen more or less."""
    return F.array(*[F.struct(*[b.alias(n) for b, n in zip(ppm_window(mass + F.lit(d), ppm), ("low", "high"), strict=True)]) for d in (0.0, shift, -shift)])


def open_interval(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with low < column < high; both bounds reach the file scan."""
    return df.filter((F.col(column) > low) & (F.col(column) < high))


def range_scan(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with low <= column <= high; both bounds reach the file scan."""
    return df.filter(F.col(column).between(low, high))


def lookup_join(df: DataFrame, table: DataFrame, key: str, required: bool = True) -> DataFrame:
    """Add the columns of ``table`` by key; with ``required`` the computation fails on a key that the table lacks."""
    out = df.join(table.withColumn("__found", F.lit(True)), key, "left")
    if required:
        missing = F.raise_error(F.concat(F.lit(f"{key} not in the table: "), F.col(key).cast("string")))
        out = out.withColumn(key, F.when(F.col("__found"), F.col(key)).otherwise(missing.cast(dict(df.dtypes)[key])))
    return out.drop("__found")


def semi_anti_split(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among ``keys``, and the others (null keys too)."""
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def first_tier(pairs: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first frame that has any for a key: exact matches, else the next kind of match, and so on."""
    out = pairs[0].withColumn("tier", F.lit(1).cast("long"))
    for n, more in enumerate(pairs[1:], 2):
        out = out.unionByName(more.join(out.select(key).distinct(), key, "left_anti").withColumn("tier", F.lit(n).cast("long")))
    return out


def rounded_join(left: DataFrame, right: DataFrame, columns: list[str], decimals: int = 2) -> DataFrame:
    """Natural join on columns rounded to ``decimals``."""
    cut = lambda df: df.withColumns({c: F.round(c, decimals) for c in columns})
    return cut(left).join(cut(right), columns)


def pair_union(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both orientations of a table of symmetric pairs, each once."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(a, b, *rest).union(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *rest)).distinct()
