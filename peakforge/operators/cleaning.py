"""Cleaning of metadata and peaks, annotation checks and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import ION_MODES
from ..functions import peaks as P

MISSING = ("", "n/a", "na", "nan", "none", "null", "no data", "undefined", "unknown")  # fixed values: spellings of nothing
INCHIKEY = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"


def known(c: Column) -> Column:
    """Trimmed text, null where it spells nothing."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*MISSING), t)


def number(c: Column) -> Column:
    """The leading number of a text such as ``12.5 min``; null if there is none."""
    text = F.regexp_extract(c.cast("string"), r"[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?", 0)
    return F.nullif(text, F.lit("")).try_cast("double")


def clean_metadata(df: DataFrame, require_precursor: bool = True) -> DataFrame:
    """Harmonise names and types of whatever metadata columns there are; drop rows without precursor m/z."""
    rules = {
        "precursor_mz": number,
        "retention_time": number,
        "retention_index": number,
        "ionmode": lambda c: F.when(F.lower(F.trim(c)).isin("positive", "negative"), F.lower(F.trim(c))).when(F.lower(F.trim(c)).isin("+", "pos", "p"), "positive").when(F.lower(F.trim(c)).isin("-", "neg", "n"), "negative"),
        "compound_name": lambda c: F.regexp_replace(known(c), r"[; ]+$", ""),
        **{k: known for k in ("smiles", "inchi", "inchikey", "adduct")},
    }
    out = df.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in df.columns})
    if "inchikey" in df.columns:
        out = out.withColumn("inchikey14", F.substring("inchikey", 1, 14))
    return out.filter(F.col("precursor_mz").isNotNull()) if require_precursor else out


def normalise_and_filter(df: DataFrame, peaks: str = "peaks", low: float = 0.001, mz_max: float = 1000.0, most: int = 500, least: int = 3) -> DataFrame:
    """Relative intensities in [low, 1], m/z in [0, mz_max], the ``most`` largest peaks; spectra with fewer than ``least`` peaks go."""
    p = P.keep_largest(P.keep_mz(P.keep_intensity(P.normalise(F.col(peaks)), low), 0.0, mz_max), most)
    return df.withColumn(peaks, p).filter(F.size(peaks) >= least)


def minimal_processing(df: DataFrame, peaks: str = "peaks", mz_min: float = 10.0, least: int = 5, below: float = 1000.0) -> DataFrame:
    """m/z of ``mz_min`` at least, and ``least`` peaks or more below ``below``."""
    out = df.withColumn(peaks, F.filter(peaks, lambda p: p["mz"] >= mz_min))
    return out.filter(F.size(F.filter(peaks, lambda p: p["mz"] < below)) >= least)


def word_processing(df: DataFrame, peaks: str = "peaks", mass: str = "parent_mass", least: int = 5) -> DataFrame:
    """Peaks for word embeddings: normalised, limited in number by the mass, at least ``least``; adds losses in 10 to 200."""
    p = P.relative_limit(P.keep_mz(P.normalise(F.col(peaks))), F.col(mass))
    out = df.withColumn(peaks, p).filter(F.size(peaks) >= least)
    return out.withColumn("losses", P.losses(F.col(peaks), F.col("precursor_mz"), 10.0, 200.0)) if "precursor_mz" in df.columns else out


def drop_empty(df: DataFrame, peaks: str = "peaks") -> DataFrame:
    return df.filter(F.size(peaks) > 0)


def keep_ion_mode(df: DataFrame, mode: str, column: str = "ionmode", nulls: bool = False, report: Observation | None = None) -> DataFrame:
    """Rows of one ion mode; with ``nulls`` also rows without one. ``report`` gets ``kept`` and ``removed`` when the result is
    computed."""
    if mode not in ION_MODES:
        raise ValueError(f"ion mode must be one of {ION_MODES}: {mode!r}")
    same = F.coalesce(F.col(column) == mode, F.lit(nulls))
    if report is not None:
        df = df.observe(report, F.count_if(same).alias("kept"), F.count_if(~same).alias("removed"))
    return df.filter(same)


def check_ion_mode(df: DataFrame, library_mode: str | None, column: str = "ionmode") -> DataFrame:
    """Fail, when the result is computed, on a row whose mode is not the library's; null on either side passes."""
    if library_mode is None:
        return df
    wrong = F.col(column).isNotNull() & (F.col(column) != library_mode)
    message = F.concat(F.lit(f"the library is of {library_mode} mode, a query of "), F.col(column))
    return df.withColumn(column, F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.col(column)))


def probe_ion_mode(df: DataFrame, column: str = "ionmode", order: str = "spectrum_id", modes=ION_MODES) -> DataFrame:
    """One row (ionmode): that of the first row with a known mode, null if there is none."""
    return df.filter(F.col(column).isin(*modes)).agg(F.min_by(column, order).alias("ionmode"))


def harmonise_annotation(df: DataFrame) -> DataFrame:
    """Null for spelled-out nothing, and smiles, inchi and inchikey put into their own columns where they were swapped."""
    cols = ["smiles", "inchi", "inchikey"]
    given = [known(F.col(c)) for c in cols]

    def first(test) -> Column:
        return F.coalesce(*[F.when(test(g), g) for g in given])

    is_inchi, is_key = (lambda c: c.startswith("InChI=")), (lambda c: c.rlike(INCHIKEY))
    return df.withColumns({"inchi": first(is_inchi), "inchikey": first(is_key), "smiles": first(lambda c: ~is_inchi(c) & ~is_key(c))})


def fully_annotated() -> Column:
    """Valid smiles, inchi and inchikey, and a precursor m/z."""
    parts = [F.col("inchikey").rlike(INCHIKEY), F.col("inchi").rlike(r"^(InChI=)?1S?/"), F.col("smiles").rlike(r"^[^\s]+$"), F.col("precursor_mz").isNotNull()]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def split_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the condition, and all others (also where it is null)."""
    yes = F.coalesce(condition, F.lit(False))
    return df.filter(yes), df.filter(~yes)


def split_annotated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_where(df, fully_annotated())


def clean_and_split(df: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning: metadata, ion mode, annotations, peaks; annotated and unannotated spectra."""
    out = keep_ion_mode(clean_metadata(df), mode)
    return split_annotated(normalise_and_filter(harmonise_annotation(out)))


def fill_charge(df: DataFrame, charge: int = 1, change_all: bool = False, column: str = "charge") -> DataFrame:
    """``charge`` where there is none, or everywhere."""
    return df.withColumn(column, F.lit(charge) if change_all else F.coalesce(F.col(column), F.lit(charge)))


def strip_name(name: Column) -> Column:
    """Without ``;`` and spaces at either end."""
    return F.regexp_replace(name, r"^[; ]+|[; ]+$", "")


def class_of(column: Column, positive: str, negative: str) -> Column:
    """positive, negative or unknown, by what the text contains."""
    return F.when(F.contains(F.lower(column), F.lit(positive)), "positive").when(F.contains(F.lower(column), F.lit(negative)), "negative").otherwise("unknown")
