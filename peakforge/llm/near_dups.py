"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Signatures (after Ertl, "BagMinHash - Minwise Hashing Algorithm for Weighted Sets"): the weights of a shingle are
discretised to integers and cut into dyadic levels (0,1], (1,2], (2,4], ...; each (shingle, level) owns a Poisson process
whose points have a time, a signature component and a weight coordinate. A component's value is the time of the
earliest point whose coordinate lies within the shingle's weight, so two texts agree in a component with probability
equal to their weighted Jaccard similarity. Points are drawn in order of time and only up to the time by which all
components are filled, so the work hardly depends on the text's length.

Classes: equal texts collapse first. Signatures are cut into bands; in every band bucket each text is compared with
the bucket's least key only, and the multiset overlap is verified on the whole texts. Connected components of the
verified links are formed, and then all pairs of a bucket that are still in different components and whose
signatures agree well enough are verified too, in blocks, so that no link between components is lost, while large
groups of alike texts never meet pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, salted_join

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class NearConfig:
    """``bands`` of ``rows`` components; ``slack``: how far below ``similarity`` a signature's estimate may lie for a
    pair to be verified (more than four standard deviations); ``block``: texts of a bucket that are compared at once."""

    similarity: float = 0.8
    shingle: int = 5
    bands: int = 26
    rows: int = 5
    slack: float = 0.15
    block: int = 512

    @property
    def components(self) -> int:
        return self.bands * self.rows


#: Sets of up to this many keys are broadcast; larger ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_UNITS = 400_000  # (shingle, level) pairs that are drawn at once


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class _Words(dict):
    """64-bit hashes of words, kept for the most recent words."""

    def __missing__(self, word: str) -> int:
        import hashlib

        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_WORDS = _Words()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words, repeats included; a shorter text is one run; no words, no runs."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
    return _mixed(out)


def bag(text: str | None, size: int = 5) -> np.ndarray:
    """The multiset as a set: the n-th repeat of a shingle has a hash of its own. Sorted."""
    s = np.sort(shingles(text, size))
    if not len(s):
        return s
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.flatnonzero(new)
    repeat = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return np.sort(_mixed(s + repeat.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Times of ``m`` components for each (distinct shingle hashes, their counts); infinite for an empty multiset."""
    out = np.full(len(bags) * m, np.inf)
    weight = np.array([c.sum() for _, c in bags], float)
    owner = np.repeat(np.arange(len(bags)), [len(c) for _, c in bags])
    if not len(owner):
        return out.reshape(len(bags), m)
    element, count = np.concatenate([e for e, _ in bags]), np.concatenate([c for _, c in bags]).astype(float)
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    lo = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, lo)
    owner, most = owner[at], count[at]
    state = _mixed(element[at] + (level + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    step = 1.0 / (m * width)
    time = np.zeros(len(at))

    def draw(i: np.ndarray) -> None:
        """The next point of each process."""
        state[i] = _mixed(state[i] + np.uint64(0x9E3779B97F4A7C15))
        time[i] -= np.log((state[i] >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) * step[i]

    draw(np.arange(len(at)))
    until = (np.log(m) + 3.0) / np.maximum(weight, 1)
    todo = np.arange(len(at))
    while len(todo):
        live = todo[time[todo] <= until[owner[todo]]]
        while len(live):
            h = _mixed(state[live] ^ np.uint64(0x2545F4914F6CDD1D))
            inside = lo[live] + width[live] * ((h >> np.uint64(32)).astype(float) * 2.0**-32) <= most[live]
            where = owner[live] * m + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out, where[inside], time[live][inside])
            draw(live)
            live = live[time[live] <= until[owner[live]]]
        unfilled = np.isinf(out.reshape(len(bags), m)).any(axis=1) & (weight > 0)
        until[unfilled] *= 1.5
        todo = np.flatnonzero(unfilled[owner])
    return out.reshape(len(bags), m)


def band_keys(times: np.ndarray, config: NearConfig) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = times.view(np.uint64).reshape(len(times), config.bands, config.rows)
    key = np.arange(1, config.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x8CB92BA72F3D8DD7)
    for r in range(config.rows):
        key = _mixed(key ^ bits[:, :, r])
    return key


def _signed(texts: DataFrame, config: NearConfig) -> DataFrame:
    """(key, text) -> (key, bands, sig), once per key and task; texts without words are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def made(keys: list[int], bags: list) -> pa.RecordBatch:
            times = signatures(bags, config.components)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * config.bands, pa.int32()), pa.array(band_keys(times, config).view(np.int64).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), bands, pa.array([t.tobytes() for t in times.astype(np.float32)], pa.binary())], ["key", "bands", "sig"])

        for batch in batches:
            keys, bags, units = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(key)
                s = shingles(text.as_py(), config.shingle)
                if not len(s):
                    continue
                keys.append(key)
                bags.append(np.unique(s, return_counts=True))
                units += len(bags[-1][0])
                if units > _UNITS:
                    yield made(keys, bags)
                    keys, bags, units = [], [], 0
            if keys:
                yield made(keys, bags)

    return texts.mapInArrow(sign, "key long, bands array<long>, sig binary")


def _bags(texts: DataFrame, config: NearConfig) -> DataFrame:
    """(key, text) -> (key, bag, n), once per key and task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, held, size = [], [], 0

            def made() -> pa.RecordBatch:
                at = np.cumsum([0] + [len(b) for b in held])  # noqa: B023
                arrays = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(held).view(np.int64)))]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, ["key", "bag"])

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(key)
                keys.append(key)
                held.append(bag(text.as_py(), config.shingle))
                size += len(held[-1])
                if size > 1 << 20:
                    yield made()
                    keys, held, size = [], [], 0
            if keys:
                yield made()

    return texts.mapInArrow(pack, "key long, bag array<long>")


def _only(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (``left_anti``: is not) among ``keys``, without shuffling ``df`` if these are few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", how)


def _verified(pairs: DataFrame, bags: DataFrame, config: NearConfig) -> DataFrame:
    """``pairs`` (a, b) whose multisets overlap enough."""
    one = bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"))
    two = bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    enough = shared >= F.lit(config.similarity) * (F.size("bag_a") + F.size("bag_b") - shared) - F.lit(1e-9)
    small, large = F.least(F.size("bag_a"), F.size("bag_b")), F.greatest(F.size("bag_a"), F.size("bag_b"))
    return both.filter(small >= F.lit(config.similarity) * large - F.lit(1e-9)).filter(enough).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (key, root): the least key of each connected component, for all keys that have a link.

    Least labels go along the links and then to the label's own label, until nothing changes; every round is written
    to the shared folder. A hub's rows are combined before each shuffle and its joins can be split.
    """
    both = materialize(links.union(links.select("b", "a")).toDF("key", "other").distinct(), "links")
    labels = materialize(both.groupBy("key").agg(F.least(F.col("key"), F.min("other")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), F.col("root").alias("theirs")), "other")
        near = near.groupBy("key").agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(near, "key").select("key", F.least("root", "theirs").alias("root"), F.col("root").alias("old"))
        jumped = hooked.join(labels.select(F.col("key").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialize(jumped.select("key", F.least("root", F.coalesce("next", "root")).alias("root"), "old"), "labels")
        changed = new.filter("root <> old").limit(1).count()
        labels = new.select("key", "root")
        if not changed:
            return labels


def overlaps(bag: np.ndarray, others: list[np.ndarray], piece: int = 1 << 21) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    out, at = np.zeros(len(others), np.int64), 0
    while at < len(others):
        end, size = at, 0
        while end < len(others) and (end == at or size + len(others[end]) <= piece):
            size += len(others[end])
            end += 1
        flat = np.concatenate(others[at:end])
        where = np.minimum(np.searchsorted(bag, flat), len(bag) - 1)
        owner = np.repeat(np.arange(at, end), [len(o) for o in others[at:end]])
        out += np.bincount(owner[bag[where] == flat], minlength=len(others))
        at = end
    return out


def _block_links(config: NearConfig):
    """Links between the members of one block that are in different components, at most one for a text and component.

    A pair is looked at in the first bucket that both share, if the signatures agree well enough; then the multisets
    are compared in full.
    """
    least = round((config.similarity - config.slack) * config.components)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(group["kind"].iat[0]), np.int64(group["bucket"].iat[0])
        sig = np.frombuffer(b"".join(group["sig"]), np.float32).reshape(len(group), -1)
        bands = np.stack(group["bands"].to_list())
        bags = [np.asarray(b, np.int64).view(np.uint64) for b in group["bag"]]
        size = np.array([len(b) for b in bags])
        key, root, head = group["key"].to_numpy(), group["root"].to_numpy(), group["head"].to_numpy()
        here = int(np.flatnonzero(bands[0] == bucket)[0])
        found = []
        for i in np.flatnonzero(~head):
            near = (root != root[i]) & (head if kind == 0 else (key > key[i]) & ~head)
            near &= np.minimum(size, size[i]) >= config.similarity * np.maximum(size, size[i]) - 1e-9
            j = np.flatnonzero(near)
            j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
            j = j[(bands[j] == bands[i]).argmax(axis=1) == here]
            if not len(j):
                continue
            shared = overlaps(bags[i], [bags[x] for x in j])
            j = j[shared >= config.similarity * (size[j] + size[i] - shared) - 1e-9]
            _, first = np.unique(root[j], return_index=True)
            found += [(key[i], key[x]) for x in j[first]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


#: Shingles of one side of a block, about.
_BLOCK_SHINGLES = 1 << 20


def _residual(members: DataFrame, signed: DataFrame, bags: DataFrame, config: NearConfig) -> DataFrame:
    """Links (a, b) between members of one bucket that are still in different components.

    ``members``: bucket, key, root, n (shingles). In each bucket the members of its least root form one side and the rest
    the other; blocks of the rest meet all blocks, blocks of the first side do not meet each other.
    """
    head = F.col("root") == F.col("least")
    sizes = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("rows"))
    open_ = materialize(salted_join(members, sizes.filter("least <> most and rows > 2").select("bucket", "least"), "bucket", "key"), "open-buckets")
    keys = materialize(open_.select("key").distinct(), "open-keys")
    weight = lambda side: F.greatest(F.ceil(F.sum(F.when(side, F.col("n")).otherwise(0)) / _BLOCK_SHINGLES), F.ceil(F.count_if(side) / config.block), F.lit(1)).cast("long")
    blocks = open_.groupBy("bucket").agg(weight(head).alias("heads"), weight(~head).alias("rests"))
    own = F.pmod(F.xxhash64("key"), F.when(head, F.col("heads")).otherwise(F.col("rests")))
    open_ = salted_join(open_, blocks, "bucket", "key").select("bucket", "key", "root", head.alias("head"), own.alias("own"), "heads", "rests")
    among = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_heads = F.transform(among("heads"), lambda j: F.struct(F.lit(0).alias("kind"), F.col("own").alias("x"), j.alias("y")))
    with_rests = F.transform(among("rests"), lambda j: F.struct(F.lit(1).alias("kind"), F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y")))
    of_head = F.transform(among("rests"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("x"), F.col("own").alias("y")))
    dealt = open_.select("bucket", "key", "root", "head", F.explode(F.when(F.col("head"), of_head).otherwise(F.concat(with_heads, with_rests))).alias("at"))
    dealt = dealt.select("bucket", "key", "root", "head", "at.kind", "at.x", "at.y")
    own = materialize(_only(signed, keys).join(bags, "key"), "open-texts")
    return dealt.join(own, "key").groupBy("bucket", "kind", "x", "y").applyInPandas(_block_links(config), "a long, b long")


def text_key(docs: DataFrame, text: str = "text") -> Column:
    """A 64-bit key of each text that different texts of ``docs`` do not share.

    A second, independent hash tells texts whose first hash agrees apart: 128 bits in all. Such texts are few in 10^11;
    their keys come from a third hash. Null texts have a null key.
    """
    own = F.col(f"`{text}`")
    hashes = docs.filter(own.isNotNull()).select(F.xxhash64(own).alias("key"), F.xxhash64(F.lit(7), own).alias("other"))
    clash = hashes.groupBy("key").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most")
    return _key_of(own, [r["key"] for r in clash.collect()])


def _key_of(own: Column, clashes: list[int]) -> Column:
    key = F.xxhash64(own)
    return F.when(own.isNotNull(), F.when(key.isin(clashes), F.xxhash64(F.lit(8), own)).otherwise(key) if clashes else key)


def near_classes(docs: DataFrame, text: str = "text", config: NearConfig | None = None, key: Column | None = None) -> DataFrame:
    """(key, root) for all texts that have near duplicates; key and root are ``text_key`` of whole texts."""
    config = config or NearConfig()
    own = F.col(f"`{text}`")
    key = text_key(docs, text) if key is None else key
    texts = docs.filter(own.isNotNull()).select(key.alias("key"), own.alias("text"))
    signed = materialize(_signed(texts, config).dropDuplicates(["key"]), "signatures")
    in_bands = signed.select("key", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = materialize(in_bands.join(shared, "bucket"), "buckets")
    keys = materialize(members.select("key").distinct(), "near-keys")
    bags = materialize(_bags(_only(texts, keys), config).dropDuplicates(["key"]), "near-bags")
    stars = members.filter("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    links = materialize(_verified(stars, bags, config), "star-links")
    roots = components(links)
    rooted = members.select("bucket", "key").join(roots, "key", "left").join(bags.select("key", F.size("bag").alias("n")), "key")
    more = materialize(_residual(rooted.withColumn("root", F.coalesce("root", "key")), signed, bags, config), "residual-links")
    return roots if more.isEmpty() else components(materialize(links.union(more), "all-links"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", config: NearConfig | None = None) -> DataFrame:
    """One row (doc_id, class_id) per document; class_id is the least doc_id of its class.

    Classes are the connected components of the links between equal texts and texts whose five-word shingle multisets
    overlap by ``similarity`` or more. Texts without words are alike only if they are equal; a null text is a class of
    its own. Rows with null doc_id count as last; repeated rows each give a row. An empty table gives an empty result.

    Only texts that others equal or resemble are joined to the rows; these joins are salted, as one text or one class may
    hold much of the table.
    """
    key = text_key(docs, text)
    roots = near_classes(docs, text, config, key)
    rows = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key")), "near-rows")
    firsts = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    several = materialize(firsts.join(roots, "key", "left").filter("n > 1 or root is not null").select("key", "first", F.coalesce("root", "key").alias("root")), "near-firsts")
    classes = several.groupBy("root").agg(F.min("first").alias("class_id"))
    named = materialize(salted_join(several.select("key", "root"), classes, "root", "key").select("key", "class_id", F.lit(True).alias("known")), "near-classes")
    found = salted_join(rows.filter("key is not null"), named, "key", "doc_id", "left")
    out = found.select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    return out.unionByName(rows.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", config: NearConfig | None = None) -> DataFrame:
    """One document of each class: the row with the least doc_id; null texts all stay. Of repeated rows one stays.

    The columns stay as they are, whatever their names; an empty table stays empty. The first of each class is found by
    sums over texts and then over classes, combined before each shuffle; the rows that go are those that are no such first, by
    id and text, so nothing is dealt by class. Only they are joined to the documents, by broadcast if they are few.
    """
    key = text_key(docs, text)
    roots = near_classes(docs, text, config, key)
    own = F.col(f"`{text}`")
    rows = docs.filter(own.isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    firsts = rows.groupBy("key").agg(F.min(order).alias("first")).join(roots, "key", "left")
    best = firsts.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    same = lambda a, b: (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    best = materialize(best, "near-best")
    losers = materialize(rows.select("doc_id", "key").alias("r").join(best.alias("b"), same("r", "b"), "left_anti"), "near-losers")
    k, i = fresh(docs, "key"), fresh(docs, "id")
    gone = losers.select(F.col("doc_id").alias(f"{i}_gone"), F.col("key").alias(f"{k}_gone"))
    gone = F.broadcast(gone) if losers.count() <= BROADCAST_KEYS else gone
    keyed = docs.filter(own.isNotNull()).withColumn(k, key)
    kept = keyed.join(gone, (F.col(k) == F.col(f"{k}_gone")) & F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{i}_gone")), "left_anti")
    twice = materialize(rows.filter("n > 1").select("doc_id", "key").alias("r").join(losers.alias("l"), same("r", "l"), "left_anti"), "near-repeats")
    if not twice.isEmpty():
        again = twice.select(F.col("doc_id").alias(f"{i}_twice"), F.col("key").alias(f"{k}_twice"))
        on = (F.col(k) == F.col(f"{k}_twice")) & F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{i}_twice"))
        kept = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates([k]))
    return kept.drop(k).unionByName(docs.filter(own.isNull()))
