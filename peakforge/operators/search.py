"""Analog search: candidates, features, ranking, export. One set-oriented plan for all queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchSettings
from ..functions.vectors import cosine, top_k_and_means, top_k_cosine
from ..schema import OUTPUT_CLASSES, output_columns
from .joins import lookup_join
from .library import Library

#: Model features in their fixed order.
FEATURES = ("precursor_mz_library", "precursor_mz_difference", "second_score", "average_embedding_score", "average_tanimoto")


def neighbourhood_scores(means: DataFrame, neighbours: DataFrame, wanted: DataFrame | None = None, query: str = "query_id", key: str = "inchikey14") -> DataFrame:
    """Per (query, structure) the mean over the structure's neighbours of their mean score and of their Tanimoto score.

    ``means``: (query, key, mean_score) over all library spectra; ``neighbours``: (key, neighbour, tanimoto);
    ``wanted``: (query, key) that are needed, which restricts the means before they are joined.
    """
    if wanted is not None:
        reach = wanted.select(query, key).distinct().join(neighbours.select(key, "neighbour"), key).select(query, F.col("neighbour").alias(key)).distinct()
        means = means.join(reach, [query, key], "left_semi")
    near = neighbours.select(key, "neighbour", "tanimoto").join(means.select(query, F.col(key).alias("neighbour"), "mean_score"), "neighbour")
    out = near.groupBy(query, key).agg(F.avg("mean_score").alias("average_embedding_score"), F.avg("tanimoto").alias("average_tanimoto"))
    return out if wanted is None else out.join(wanted.select(query, key).distinct(), [query, key], "left_semi")


def candidates(queries: DataFrame, library: Library, k: int) -> DataFrame:
    """The k best spectra of each query by embedding cosine: query_id, spectrum_id, inchikey14, embedding_score."""
    lib = library.embeddings.join(library.spectra.select("spectrum_id", "inchikey14"), "spectrum_id")
    return top_k_cosine(queries, lib, k, carry=("inchikey14",)).withColumnRenamed("score", "embedding_score")


def features(queries: DataFrame, library: Library, k: int) -> DataFrame:
    """Candidates with the model's features. ``queries``: query_id, precursor_mz, embedding, second_embedding."""
    lib = library.embeddings.join(library.spectra.select("spectrum_id", "inchikey14"), "spectrum_id")
    found, means = top_k_and_means(queries.select("query_id", "embedding"), lib, k, "inchikey14")
    found = found.withColumnRenamed("score", "embedding_score")
    near = library.structures.select("inchikey14", F.explode("neighbours").alias("n")).select("inchikey14", F.col("n.inchikey14").alias("neighbour"), "n.tanimoto")
    around = neighbourhood_scores(means, near, found)
    own = queries.select("query_id", F.col("precursor_mz").alias("precursor_mz_query"), F.col("second_embedding").alias("__q"))
    out = found.join(around, ["query_id", "inchikey14"], "left").join(own, "query_id")
    out = out.join(library.spectra.select("spectrum_id", F.col("precursor_mz").alias("precursor_mz_library")), "spectrum_id")
    out = out.join(library.second_embeddings.select("spectrum_id", F.col("embedding").alias("__v")), "spectrum_id")
    return out.withColumn("second_score", cosine(F.col("__q"), F.col("__v"))).withColumn("precursor_mz_difference", F.abs(F.col("precursor_mz_library") - F.col("precursor_mz_query"))).drop("__q", "__v")


def linear_score(f: Callable[[str], Column] = F.col) -> Column:
    """A fixed linear model of the features, where no trained model is given."""
    return f("average_embedding_score") * 0.5 + f("average_tanimoto") * 0.3 + f("second_score") * 0.2 - F.least(f("precursor_mz_difference") / 1000.0, F.lit(0.5))


def rank_results(scored: DataFrame, n: int, minimum: float, score: str = "prediction", query: str = "query_id") -> DataFrame:
    """The n best of each query (ties: embedding score, id), then only those above ``minimum`` (strictly)."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.desc("embedding_score"), "spectrum_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter((F.col("rank") <= n) & (F.col(score) > minimum))


def export_results(ranked: DataFrame, library: Library, settings: SearchSettings, numbers: DataFrame | None = None) -> DataFrame:
    """Result columns in their fixed order; metadata and classes are joined to the few ranked rows only.

    ``numbers``: (query_id, query_spectrum_nr); without it the number is query_id + 1. Metadata the library lacks is null.
    """
    have = library.spectra.columns
    extra = [c for c in ("inchikey", "compound_name", "smiles", *settings.metadata_columns) if c in have]
    out = lookup_join(ranked, library.spectra.select("spectrum_id", *dict.fromkeys(extra)), "spectrum_id")
    classes = library.has_classes()
    if classes:
        out = lookup_join(out, library.structures.select("inchikey14", *OUTPUT_CLASSES), "inchikey14")
    out = out.join(numbers, "query_id") if numbers is not None else out.withColumn("query_spectrum_nr", F.col("query_id") + 1)
    names = {"model_prediction": "prediction", "precursor_mz_query_spectrum": "precursor_mz_query", "precursor_mz_analog": "precursor_mz_library", "analog_compound_name": "compound_name"}
    columns = [F.col(names.get(c, c)).alias(c) if names.get(c, c) in out.columns else F.lit(None).cast("string").alias(c) for c in output_columns(settings.metadata_columns, settings.score_columns, classes)]
    more = [c for c in (numbers.columns if numbers is not None else []) if c not in ("query_id", "query_spectrum_nr")]
    return out.select(*columns, F.col("rank"), *more)


def formatted(results: DataFrame, decimals: int = 4) -> DataFrame:
    """Floats as text with a fixed number of decimals, for CSV; null stays null."""
    return results.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c))).alias(c) if t in ("double", "float") else F.col(c) for c, t in results.dtypes])


def analog_search(queries: DataFrame, library: Library, settings: SearchSettings | None = None, model: Callable[[DataFrame], DataFrame] | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """The whole search. ``model`` adds ``prediction`` to the feature table; without one ``linear_score`` does.

    ``numbers``: (query_id, query_spectrum_nr, ...), of which further columns are added at the end.
    """
    settings = settings or SearchSettings()
    if settings.filter_on_ion_mode and "ionmode" in queries.columns:
        queries = queries.filter(F.col("ionmode").isNull() | (F.col("ionmode") == settings.filter_on_ion_mode))
    found = features(queries, library, settings.preselection)
    scored = model(found) if model else found.withColumn("prediction", linear_score())
    return export_results(rank_results(scored, settings.n_analogs, settings.min_score), library, settings, numbers)
