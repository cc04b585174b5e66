"""Search of query spectra as they arrive in a folder: a file stream against static library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import SearchSettings
from ..operators.library import Library
from ..operators.search import analog_search


def stream_queries(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Parquet files of queries (query_id, precursor_mz, embedding, second_embedding) in a folder, as a stream."""
    schema = "query_id long, precursor_mz double, embedding array<float>, second_embedding array<float>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def search_stream(queries: DataFrame, library: Library, out: str, checkpoint: str, settings: SearchSettings | None = None, model=None, once: bool = False):
    """Start the search; every batch of queries becomes one folder ``batch=N`` of results, rewritten if it is run again.

    ``once``: stop after the files that are there now.
    """

    def search(batch: DataFrame, number: int) -> None:
        analog_search(batch, library, settings, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.trigger(availableNow=True) if once else queries.writeStream
    return writer.foreachBatch(search).option("checkpointLocation", checkpoint).start()
