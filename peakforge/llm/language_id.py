"""Language identification by bit-sliced Bloom filters over character n-grams.

A filter has ``slots`` rows; row s holds one bit per language, in as many words as the languages need. An n-gram's
``probes`` rows, joined by AND, are the set of all languages whose training texts contain it (with the chance of false
positives that a language's fill allows). A language contains an n-gram if enough of its training texts do, also against
other languages, so that foreign passages teach it nothing. A text's n-grams give one count per language, and the share
(count / n-grams) is corrected for the expected false positives: (share - fp) / (1 - fp). The language with the largest
corrected share wins.

Fitting reads a sample of about ``max_docs`` labelled texts for each language (chosen by a hash of the row, so it grows with
the languages only) and keeps all their n-grams that pass these conditions.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UND = "und"
WORD = 64  # languages whose bits one word of a slot holds
_PIECE = 1 << 20  # characters that are hashed at once


@dataclass(frozen=True)
class BloomConfig:
    sizes: tuple[int, ...] = (3, 5)
    max_docs: int = 1500
    min_docs: int = 2  # training texts of a language that must contain an n-gram, if it has more than 20 texts
    min_ratio: float = 0.2  # least rate of an n-gram in a language's texts, against the language with the highest rate
    slots_log2: int = 21  # at least; a filter has four slots or more for every n-gram of its largest language
    probes: int = 3


@dataclass
class LanguageFilter:
    config: BloomConfig
    langs: list[str]
    rows: list[np.ndarray]  # words; each of slots, of unsigned integers with a bit per language, 64 at most
    fp: np.ndarray  # false-positive rate per language

    @classmethod
    def build(cls, config: BloomConfig, grams: dict[str, np.ndarray]) -> LanguageFilter:
        langs = sorted(grams)
        most = max(map(len, grams.values()), default=0)
        config = replace(config, slots_log2=max(config.slots_log2, (4 * most - 1).bit_length() if most else 0))
        words = []
        for start in range(0, max(len(langs), 1), WORD):
            part = langs[start : start + WORD]
            bits = next(b for b in (8, 16, 32, WORD) if len(part) <= b)
            rows = np.zeros(1 << config.slots_log2, dtype=f"u{bits // 8}")
            for i, lang in enumerate(part):
                for at in _slots(grams[lang], config):
                    rows[at] |= rows.dtype.type(1 << i)
            words.append(rows)
        fill = np.array([np.count_nonzero(_bit(words[i // WORD], i % WORD)) / (1 << config.slots_log2) for i in range(len(langs))])
        return cls(config, langs, words, fill**config.probes)

    def lookup(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """Language sets of hashed n-grams, as bit masks: of the first WORD languages, or of the next ones."""
        out, rows = None, self.rows[word]
        for at in _slots(grams, self.config):
            out = rows[at] if out is None else out & rows[at]
        return out

    def shares(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Corrected shares, texts by languages, between 0 and 1."""
        raw = hits / np.maximum(total, 1)[:, None]
        return np.clip((raw - self.fp) / (1 - self.fp), 0, 1)


def _bit(rows: np.ndarray, i: int) -> np.ndarray:
    return rows >> rows.dtype.type(i) & rows.dtype.type(1)


def _slots(grams: np.ndarray, config: BloomConfig) -> Iterator[np.ndarray]:
    mask = np.uint64((1 << config.slots_log2) - 1)
    for k in range(config.probes):
        bits = grams >> np.uint64(21 * k) if config.slots_log2 <= 21 and k < 3 else _mixed(grams + np.uint64(k))
        yield (bits & mask).astype(np.intp)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@cache
def _words() -> re.Pattern:
    """Runs of letters and combining marks (Unicode categories L and M)."""
    inside = [unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)]
    ends = np.flatnonzero(np.diff(np.array([False, *inside, False]).astype(np.int8)))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(ends[::2], ends[1::2], strict=True)) + "]+")


def prepared(text: str) -> str:
    """The distinct words (runs of letters and marks that hold a letter, lower-cased) between single spaces; empty if
    there is no letter.

    A word counts once, so that a line repeated a thousand times weighs no more than one.
    """
    words = [w for w in dict.fromkeys(_words().findall(text.lower())) if w[0].isalpha() or any(map(str.isalpha, w))]
    return f" {' '.join(words)} " if words else ""


def has_letters(text: Column) -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def inside_words(codes: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` code points have no space but at their ends."""
    space = codes == 32
    out = np.ones(len(codes) - n + 1, bool)
    for j in range(1, n - 1):
        out &= ~space[j : len(codes) - n + 1 + j]
    return out


def hashed_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` code points."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j]
    return _mixed(h)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _pieces(s: str, longest: int) -> Iterator[str]:
    """Parts of bounded length that share no n-gram and lose none, if n-grams have ``longest`` characters."""
    for at in range(0, max(1, len(s) - longest + 1), _PIECE):
        yield s[at : at + _PIECE + longest - 1]


def _count_texts(texts: list[str | None], model: LanguageFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits per text and language, n-grams per text, whether a text has letters."""
    L = len(model.langs)
    hits, total, letters = np.zeros((len(texts), L)), np.zeros(len(texts)), np.zeros(len(texts), bool)

    def count(codes: np.ndarray, owner: np.ndarray, n: int) -> None:
        if len(codes) < n:
            return
        g = hashed_grams(codes, n)
        own = owner[: len(g)]
        whole = (own == owner[n - 1 :]) & inside_words(codes, n)
        g, own = g[whole], own[whole]
        total.__iadd__(np.bincount(own, minlength=len(texts)))
        for i in range(L):
            if i % WORD == 0:
                found = model.lookup(g, i // WORD)
            hits[:, i] += np.bincount(own[_bit(found, i % WORD) != 0], minlength=len(texts))

    def flush(part: list[tuple[int, str]]) -> None:
        if part:
            codes = _codes("".join(s for _, s in part))
            owner = np.repeat([i for i, _ in part], [len(s) for _, s in part])
            for n in model.config.sizes:
                count(codes, owner, n)

    waiting, size = [], 0
    for i, t in enumerate(texts):
        s = prepared(t) if t else ""
        letters[i] = bool(s)
        if len(s) > _PIECE:
            for n in model.config.sizes:  # each size by itself, so that no n-gram counts twice
                for piece in _pieces(s, n):
                    codes = _codes(piece)
                    count(codes, np.full(len(codes), i), n)
            continue
        if s:
            waiting.append((i, s))
            size += len(s)
        if size > _PIECE:
            flush(waiting)
            waiting, size = [], 0
    flush(waiting)
    return hits, total, letters


def _by_lang(values: dict[str, int], lang: str, kind: str, default: int) -> Column:
    """The value of a row's language; a map, as nested conditions would grow deep with many languages."""
    if not values:
        return F.lit(default).cast(kind)
    table = F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.lit(v).cast(kind))])
    return F.coalesce(F.try_element_at(table, F.col(lang)), F.lit(default).cast(kind))


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", config: BloomConfig | None = None) -> LanguageFilter:
    """Fit on rows whose text and language are not null. Rows without letters add nothing."""
    config = config or BloomConfig()
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    spread = 1 << 40
    part = _by_lang({r["lang"]: min(spread, spread * config.max_docs // r["n"]) for r in counts}, lang, "long", 0)
    sample = rows.filter(F.pmod(F.xxhash64(text, lang), F.lit(spread)) < part).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes, longest = config.sizes, max(config.sizes)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out(name: str) -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "docs"])

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [hashed_grams(c, n)[inside_words(c, n)] for c in map(_codes, _pieces(prepared(t), longest)) for n in sizes if len(c) >= n]
                held.setdefault(name, []).append(np.unique(np.concatenate([*own, np.empty(0, np.uint64)])))
                if sum(map(len, held[name])) > 1 << 21:
                    yield out(name)
        for name in list(held):
            yield out(name)

    tables = sample.mapInArrow(grams, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    many = {r["lang"] for r in counts if r["n"] > 20}
    kept = tables.filter((F.col("docs") >= config.min_docs) | ~F.col("lang").isin(*many)) if many else tables
    drawn = _by_lang({r["lang"]: min(r["n"], config.max_docs) for r in counts}, "lang", "double", 1)
    kept = kept.withColumn("rate", F.col("docs") / drawn).withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= F.col("top") * config.min_ratio)
    found = kept.select("lang", "gram").toPandas()  # of a sample of max_docs texts a language
    learned = {name: g["gram"].to_numpy(np.int64).view(np.uint64) for name, g in found.groupby("lang")}
    return LanguageFilter.build(config, learned)


def predict_languages(docs: DataFrame, model: LanguageFilter, text: str = "text", column: str = "language") -> DataFrame:
    """Add ``column``: struct(lang, score). ``und`` and score 0 where the text is null or has no letter, or nothing was learned.

    The score is the winner's corrected share. Ties go to the language that sorts first; a text without a known
    n-gram gets that language too, with score 0. A column of that name is replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: see slots_log2

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        values = [None if t is None or t != t else t for t in texts]
        if not m.langs:
            return pd.DataFrame({"lang": [UND] * len(values), "score": [0.0] * len(values)})
        hits, total, letters = _count_texts(values, m)
        share = m.shares(hits, total)
        best = share.argmax(axis=1)
        names = np.array(m.langs, dtype=object)[best]
        names[~letters] = UND
        return pd.DataFrame({"lang": names, "score": np.where(letters, share[np.arange(len(values)), best], 0.0)})

    return docs.withColumn(column, predict(F.col(f"`{text}`")))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
