"""Command line: search a file or a folder of spectra against a library."""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ION_MODES, SearchSettings
from .functions.peaks import peak_words
from .operators.cleaning import clean_metadata, normalise_and_filter, probe_ion_mode
from .operators.library import Library, number_spectra
from .operators.model import document_embedding, onnx_scorer
from .operators.search import analog_search
from .operators.util import is_folder, stable
from .sources.loader import files_in, find_library_files, load_spectra, read_embeddings, spectrum_files
from .sources.sinks import write_by_file


def existing(path: str) -> str:
    """A path that must exist; one with a scheme is looked up by Spark later."""
    if "://" not in path and not os.path.exists(path):
        raise argparse.ArgumentTypeError(f"does not exist: {path}")
    return path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakforge", description="Search spectra for analogues and exact matches.")
    p.add_argument("--spectra", type=existing, help="spectrum file or folder of files")
    p.add_argument("--library", required=True, help="folder with the library tables")
    p.add_argument("--embeddings", type=existing, help="parquet: query_id, embedding, second_embedding of the spectra, by their order")
    p.add_argument("--word_vectors", type=existing, help="parquet: word, vector; the second embedding is then made from the spectra's peaks")
    p.add_argument("--ionmode", choices=ION_MODES, help="ion mode that the library must have")
    p.add_argument("--download", action="store_true", help="download the library first (not available: there is no network source)")
    p.add_argument("--results", help="folder for the results; default: results, beside the spectra")
    p.add_argument("--filter_ionmode", action="store_true", help="skip spectra of another ion mode")
    p.add_argument("--additional_metadata", nargs="+", default=["retention_time", "feature_id"])
    return p


def run(spark: SparkSession, argv: list[str]) -> str | None:
    """Returns the path of the results, for a folder of spectra the folder with one CSV for each file; None if there was
    nothing to do."""
    args = parser().parse_args(argv)
    if args.download:
        raise NotImplementedError("libraries cannot be downloaded; give a folder with --library")
    library = Library.open(spark, args.library)
    if args.ionmode:
        found = probe_ion_mode(library.spectra).first()["ionmode"]
        if found != args.ionmode:
            raise ValueError(f"the library's ion mode is {found}, not {args.ionmode}")
    if not args.spectra:
        print("no spectra given, nothing to do")
        return None
    folder = is_folder(spark, args.spectra)
    files = spectrum_files(spark, args.spectra) if folder else [os.path.basename(args.spectra)]
    if not files:
        return None
    base = args.spectra.rstrip("/") if folder else os.path.dirname(args.spectra)
    spectra = reduce(DataFrame.unionByName, [load_spectra(spark, f"{base}/{name}" if base else name) for name in files])
    # A query keeps the number of its place in its file, whatever cleaning removes.
    numbered = stable(number_spectra(spectra, "source_file", "record_no").withColumnRenamed("spectrum_id", "query_id"), "spectra")
    numbers = numbered.select("query_id", (F.col("record_no") + 1).alias("query_spectrum_nr"), "source_file")
    cleaned = normalise_and_filter(clean_metadata(numbered))
    queries = cleaned.select("query_id", "precursor_mz", "ionmode")
    vectors = read_embeddings(spark, args.embeddings or f"{args.library.rstrip('/')}/query_embeddings", "query_id")
    if args.word_vectors:
        words = cleaned.select("query_id", peak_words(F.col("peaks")).alias("words"), F.transform("peaks", lambda p: p["intensity"]).alias("weights"))
        second = document_embedding(words, spark.read.parquet(args.word_vectors), "query_id").withColumnRenamed("embedding", "second_embedding")
        vectors = vectors.select("query_id", "embedding").join(second, "query_id", "left")
    settings = SearchSettings(metadata_columns=tuple(args.additional_metadata), filter_on_ion_mode=args.ionmode if args.filter_ionmode else None)
    names = files_in(spark, args.library)
    model = onnx_scorer(f"{args.library.rstrip('/')}/{find_library_files(names).forest}") if any(n.endswith(".onnx") for n in names) else None
    results = analog_search(queries.join(vectors, "query_id"), library, settings, model, numbers)
    out = args.results or f"{base or '.'}/results"
    paths = write_by_file(results, out, files)
    return out if folder else paths[0]


def main() -> None:
    spark = SparkSession.builder.appName("peakforge").getOrCreate()
    import sys

    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
