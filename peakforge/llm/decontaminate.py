"""Benchmark decontamination by pigeonhole edit matching on words.

A test item of n words may appear in a document with up to k = floor(rate * n) word edits. It is cut into k + 1 pieces
of consecutive words, so that any such appearance holds at least one piece unchanged. One Aho-Corasick automaton
finds all pieces of all items in one pass over a document; around each hit Myers' bit-parallel algorithm computes the
least edit distance of the item to any run of the document's words.

The benchmark is searched in blocks of at most ``BLOCK_CHARS`` characters, each broadcast as one automaton.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize

RATE = 0.2
BLOCK_CHARS = 16 << 20
_WORD = re.compile(r"\w+")

LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("end_word", T.LongType())])
)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces_of(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """``errors`` + 1 runs of nearly equal length that make up ``words``, with their places."""
    cuts = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a run of ``text``, end of the first such run), by Myers' algorithm."""
    m = len(pattern)
    full, top, eq = (1 << m) - 1, 1 << m - 1, {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


@dataclass
class PieceIndex:
    """Items as (ids, words, error budget), and the automaton, whose values are lists of (item, place of the piece)."""

    items: list[tuple[list[int], list[str], int]]
    automaton: ahocorasick.Automaton

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], rate: float = RATE) -> PieceIndex:
        """Items without words are left out; items with equal words are searched once."""
        same: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in rows:
            if words := words_of(text):
                same.setdefault(tuple(words), []).append(item_id)
        items = [(ids, list(w), int(rate * len(w))) for w, ids in same.items()]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words, errors) in enumerate(items):
            for at, piece in pieces_of(words, errors):
                where.setdefault(f" {' '.join(piece)} ", []).append((n, at))
        automaton = ahocorasick.Automaton()
        for key, value in where.items():
            automaton.add_word(key, value)
        if where:
            automaton.make_automaton()
        return cls(items, automaton)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, words of the item, end word) of each item within its budget, in order of item_id."""
        words = words_of(text)
        if not words or not self.items:
            return []
        joined = f" {' '.join(words)} "
        near: dict[int, list[int]] = {}
        starts = None
        for end, places in self.automaton.iter(joined):
            if starts is None:
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))  # of the space before each word
            for n, at in places:
                size = self._piece_chars(n, at)
                near.setdefault(n, []).append(bisect_left(starts, end + 1 - size) - at)
        out = []
        for n, hits in near.items():
            ids, own, errors = self.items[n]
            best, lo, hi = (errors + 1, 0), None, None
            for start in [*sorted(set(hits)), None]:
                if start is not None and lo is not None and start - errors <= hi:
                    hi = start + len(own) + errors
                    continue
                if lo is not None:
                    distance, end = best_match(own, words[max(0, lo) : hi])
                    best = min(best, (distance, max(0, lo) + end))
                if start is not None:
                    lo, hi = start - errors, start + len(own) + errors
            if best[0] <= errors:
                out += [(i, best[0], len(own), best[1]) for i in ids]
        return sorted(out)

    def _piece_chars(self, n: int, at: int) -> int:
        if not hasattr(self, "_chars"):
            self._chars = {(i, a): len(" ".join(p)) + 2 for i, (_, w, e) in enumerate(self.items) for a, p in pieces_of(w, e)}
        return self._chars[n, at]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "leaks", rate: float = RATE) -> DataFrame:
    """Add ``column``: array of struct(item_id, distance, n_words, end_word), a row for each test item within its budget.

    Case and punctuation don't count. Null and empty texts and items match nothing, and with an empty benchmark all
    arrays are empty. Whole texts are searched; repeated rows get equal results. Items without item_id are skipped. A
    column of that name is replaced; all others stay.

    A benchmark of several blocks is searched block by block, each in a pass of its own over the documents with one
    automaton to a worker; the few texts with leaks are then joined by the MD5 of the text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    if not blocks:
        return docs.withColumn(column, F.array().cast(LEAKS))
    own, searchers = F.col(f"`{text}`"), []
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = [(r["item_id"], r["text"]) for r in block.collect()]  # about BLOCK_CHARS characters
        searchers.append(_searcher(_Block(spark.sparkContext.broadcast(rows), rate)))
    if blocks == 1:
        return docs.withColumn(column, searchers[0](own))
    passes = [docs.select(F.md5(own).alias("key"), search(own).alias("found")).filter(F.size("found") > 0).dropDuplicates(["key"]) for search in searchers]
    found = [materialize(p, "leaks") for p in passes]  # one after the other, so that a worker holds one automaton
    leaks = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))  # a row per block
    leaks = materialize(leaks, "leaks")
    k, f = fresh(docs, "key"), fresh(docs, "found")
    keep = [c for c in docs.columns if c.lower() != column.lower() or c == text]
    few = leaks.count() <= BROADCAST_LEAKS
    out = docs.withColumn(k, F.md5(own)).join((F.broadcast if few else lambda df: df)(leaks.toDF(f"{k}_", f)), F.col(k) == F.col(f"{k}_"), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f), F.array().cast(LEAKS)).alias(column))


#: Texts with leaks up to this number are broadcast; more are joined by a shuffle.
BROADCAST_LEAKS = 100_000


def _searcher(block: _Block):
    @F.pandas_udf(LEAKS)
    def search(texts: pd.Series) -> pd.Series:
        index = block.index()
        return pd.Series([index.search(t) for t in texts], dtype=object)

    return search


class _Block:
    """A broadcast block of items, whose automaton is built once in a worker process."""

    def __init__(self, shared, rate: float):
        self.shared, self.rate = shared, rate

    def index(self) -> PieceIndex:
        rows = self.shared.value
        if _KEPT.get("rows") is not rows or _KEPT.get("rate") != self.rate:
            _KEPT.update(rows=rows, rate=self.rate, index=PieceIndex.build(rows, self.rate))
        return _KEPT["index"]


_KEPT: dict = {}


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """Only the documents in which no test item appears, with their columns as they are.

    Null and empty texts stay, repeated rows stay or go together, and with an empty benchmark all documents stay.
    """
    leaks = fresh(docs, "leaks")
    return find_leaks(docs, benchmark, text, leaks, rate).filter(F.size(leaks) == 0).drop(leaks)
