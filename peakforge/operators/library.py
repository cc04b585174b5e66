"""Building a library: spectra, structures with their nearest neighbours, embeddings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sets import fingerprint_words, jaccard_pairs, nearest_by_bits
from ..schema import CLASS_COLUMNS
from .util import exists, global_rank, stable


def structure_key(inchikey: Column) -> Column:
    """The first 14 characters: the structure without stereochemistry and charge."""
    return F.substring(inchikey, 1, 14)


def number_spectra(df: DataFrame, *order: str) -> DataFrame:
    """Add spectrum_id: the dense 0-based position in the given order."""
    return global_rank(df, *order, column="spectrum_id").withColumn("spectrum_id", F.col("spectrum_id") - 1)


def ids_per_structure(df: DataFrame, key: str = "inchikey14", spectrum_id: str = "spectrum_id") -> DataFrame:
    """(key, spectrum_ids), the ids in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(spectrum_id)).alias("spectrum_ids"))


def distinct_structures(df: DataFrame, key: str = "inchikey14") -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def representative(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, order): per key the most frequent value, of equally frequent ones that seen first, and where.

    Counts are combined before the shuffle; a window over the distinct values of a key picks the first.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias(order))
    w = Window.partitionBy(key).orderBy(F.desc("__n"), order)
    return counts.withColumn("__at", F.row_number().over(w)).filter("__at = 1").select(key, value, order)


def nearest_structures(pairs: DataFrame, n: int = 10, key: str = "key_1", other: str = "key_2", score: str = "tanimoto") -> DataFrame:
    """The n best others of each key, ties by the other key: (key, other, score, rank). Fewer where there are fewer."""
    w = Window.partitionBy(key).orderBy(F.desc(score), other)
    ranked = pairs.select(key, other, score).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= n)


def tanimoto_pairs(sets: DataFrame, key: str, item: str, others: DataFrame | None = None) -> DataFrame:
    """(key_1, key_2, tanimoto) of all keys with a shared item."""
    pairs = jaccard_pairs(sets, key, item, others)
    return pairs.select("key_1", "key_2", (F.col("shared") / (F.col("size_1") + F.col("size_2") - F.col("shared"))).alias("tanimoto"))


def structures_table(spectra: DataFrame, neighbours: DataFrame, classes: DataFrame | None = None, key: str = "inchikey14") -> DataFrame:
    """(key, spectrum_ids, neighbours, classes...). ``neighbours``: rows (key, other, score, rank) of nearest_structures."""
    near = neighbours.toDF("key", "inchikey14", "tanimoto", "rank").groupBy("key")
    near = near.agg(F.sort_array(F.collect_list(F.struct("rank", "inchikey14", "tanimoto"))).alias("n"))  # at most n each
    near = near.select(F.col("key").alias(key), F.transform("n", lambda x: F.struct(x["inchikey14"].alias("inchikey14"), x["tanimoto"].alias("tanimoto"))).alias("neighbours"))
    out = ids_per_structure(spectra.filter(F.col(key).isNotNull()), key).join(near, key, "left")
    if classes is not None:
        out = out.join(classes.select(key, *[c for c in CLASS_COLUMNS if c in classes.columns]), key, "left")
    return out


@dataclass
class Library:
    """The tables of a library. Open one with ``open``, make one with ``build``."""

    spectra: DataFrame  # spectrum_id, precursor_mz, ionmode, inchikey14, ...
    structures: DataFrame  # inchikey14, spectrum_ids, neighbours, classes
    embeddings: DataFrame  # spectrum_id, embedding
    second_embeddings: DataFrame  # spectrum_id, embedding

    TABLES = ("spectra", "structures", "embeddings", "second_embeddings")

    def computed(self) -> Library:
        """The same library with its spectra and structures computed once, in the shared folder."""
        return replace(self, spectra=stable(self.spectra, "spectra"), structures=stable(self.structures, "structures"))

    @classmethod
    def open(cls, spark: SparkSession, path: str, check: bool = True) -> Library:
        out = cls(*[spark.read.parquet(f"{path}/{t}") for t in cls.TABLES])
        if check:
            out.check()
        return out

    def save(self, path: str) -> None:
        """Write the tables; none may exist, which is checked before the first is written. Spectra are sorted by precursor
        m/z within files, for range scans."""
        there = [t for t in self.TABLES if exists(self.spectra.sparkSession, f"{path}/{t}")]
        if there:
            raise FileExistsError(f"{path} already holds {', '.join(there)}")
        self.spectra.sortWithinPartitions("precursor_mz").write.mode("errorifexists").parquet(f"{path}/spectra")
        for t in self.TABLES[1:]:
            getattr(self, t).write.mode("errorifexists").parquet(f"{path}/{t}")

    def check(self) -> None:
        """Raise if the embeddings don't cover the spectra one to one or differ in dimension."""
        n = self.spectra.count()
        for t in self.TABLES[2:]:
            got = getattr(self, t).agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
            if got[0] != n or got[1] != got[2]:
                raise ValueError(f"{t}: {got[0]} rows for {n} spectra, dimensions {got[1]} to {got[2]}")

    def has_classes(self) -> bool:
        return set(CLASS_COLUMNS) <= set(self.structures.columns)

    @classmethod
    def build(cls, spectra: DataFrame, fingerprints: DataFrame, embeddings: DataFrame, second: DataFrame, classes: DataFrame | None = None, n: int = 10) -> Library:
        """``fingerprints``: rows (inchikey14, bit). Structures get their n nearest by Tanimoto, themselves included."""
        words = stable(fingerprint_words(fingerprints, "inchikey14", "bit"), "fingerprints")
        near = nearest_by_bits(words, words, n, "inchikey14")
        return cls(spectra, structures_table(spectra, near, classes), embeddings, second)
