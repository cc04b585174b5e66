"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document is expected ``target / source size`` times in the mix: the whole
part of that is allocated as certain copies, the rest is its inclusion probability. Documents are ranked within
their source by random odds over inclusion odds (Rosen's Pareto order sampling), and the first are taken until the
source's words come nearest to its target.

No source is sorted in one task: the rank's cut is found in histograms of 1024 buckets per source, twice, and only
the documents of one bucket in a million are ranked one by one. Sums by bucket are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.util import global_rank
from .common import fresh, materialize

WORDS = r"[^\x20\x09-\x0D]+"
SCALE = 1 << 52
#: A table of sources up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the parts' MD5, the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(SCALE))


def pareto_rank(u: Column, share: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) to integers below 2^52; null where the share is 0."""
    q = (u / (F.lit(1.0) - u)) / (share / (F.lit(1.0) - share))
    return F.when(share > 0, F.least(F.floor(q / (F.lit(1.0) + q) * F.lit(float(SCALE))), F.lit(SCALE - 1)))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources weigh ``weights`` in turn by code point, null last; they share ``budget`` times all words; what a source
    would get beyond ``cap`` times its size is shared again by weight until no source is above. Positions come from a
    range partitioning and each round of sharing is one sum, so many sources don't meet in one task.
    """
    placed = global_rank(sizes, F.col("source").asc_nulls_last(), column="turn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    out = materialize(placed.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most")), "sources")
    total, n = out.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    words, others, capped = (total or 0) * budget, None, -1
    full = F.lit(False)
    while n:
        got = out.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        words, others = (total or 0) * budget - (got[0] or 0.0), got[1]
        if got[2] == capped or others is None:
            break
        capped, full = got[2], F.col("most") * F.lit(others) <= F.col("weight") * F.lit(words)
    level = F.lit(words / others) if others else F.lit(None).cast("double")
    return out.select("source", "source_size", "weight", F.when(full, F.col("most")).otherwise(F.coalesce(F.col("weight") * level, F.col("most"))).alias("target"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Add size, source_size, target, copies and taken (copies times size); columns of these names are replaced.

    Null text has size 0; null is a source of its own; a source without words has target 0. Rows that are equal in id
    and text draw the same number and are taken or left together, so reruns agree whatever the order of rows. A
    source's words miss its target by half of one document (or such group) at most. Other columns stay, whatever their
    names; an empty table gives an empty result.
    """
    mine = ["size", "source_size", "target", "copies", "taken"]
    rest = [c for c in docs.columns if c.lower() not in mine or c in (text, source, doc_id)]
    body = F.col(f"`{text}`")
    size, u = n_words(body), uniform(seed, F.col(f"`{doc_id}`"), F.md5(F.coalesce(body, F.lit(""))))
    slim = materialize(docs.select(F.col(source).alias("source"), size.alias("size"), u.alias("u")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, budget, cap), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)

    def expected(t: str) -> dict[str, Column]:
        e = F.when(F.col(f"{t}.source_size") > 0, F.col(f"{t}.target") / F.col(f"{t}.source_size")).otherwise(F.lit(0.0))
        return {"certain": F.floor(e), "share": e - F.floor(e)}

    drawn = slim.alias("d").join(hint(targets.alias("t")), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    drawn = drawn.select("d.source", "d.size", "d.u", *[c.alias(n) for n, c in expected("t").items()])
    drawn = drawn.filter("share > 0").withColumn("rank", pareto_rank(F.col("u"), F.col("share")))

    def boundary(parts: DataFrame, left: str) -> DataFrame:
        """Per source the bucket in which the running sum reaches ``left``, and what is left before it."""
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = parts.withColumn("run", F.sum("size").over(w))
        run = run.filter((F.col("run") >= F.col(left)) & (F.col("run") - F.col("size") < F.col(left)))
        return run.select("source", "bucket", (F.col(left) - F.col("run") + F.col("size")).alias("need"))

    wanted = targets.select("source", ((F.col("target") - F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))) * F.col("source_size"))).alias("need"))

    def with_need(sums: DataFrame, need: DataFrame) -> DataFrame:
        return sums.alias("s").join(hint(need.alias("n")), F.col("s.source").eqNullSafe(F.col("n.source"))).select("s.*", F.col("n.need").alias("left"))

    coarse = drawn.groupBy("source", F.shiftright("rank", 42).alias("bucket")).agg(F.sum("size").alias("size"))
    edge1 = materialize(boundary(with_need(coarse, wanted), "left"), "mix-coarse")
    inside = drawn.alias("d").join(hint(edge1.alias("e")), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.rank", 42) == F.col("e.bucket"))).select("d.source", "d.size", "d.rank", "e.need")
    fine = inside.groupBy("source", "need", F.shiftright("rank", 32).alias("bucket")).agg(F.sum("size").alias("size")).withColumnRenamed("need", "left")
    edge2 = materialize(boundary(fine, "left"), "mix-fine")
    last = inside.alias("d").join(hint(edge2.alias("e")), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.rank", 32) == F.col("e.bucket")))
    last = last.groupBy("e.source", "d.rank", "e.need").agg(F.sum("d.size").alias("size"))
    w = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("middle", F.sum("size").over(w) - F.col("size") / 2).filter(F.col("middle") < F.col("need"))
    last = last.groupBy("source").agg(F.max("rank").alias("cut"))
    cuts = edge2.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left")
    cuts = cuts.select("e.source", F.coalesce("l.cut", F.shiftleft("e.bucket", 32) - 1).alias("cut"))
    plan = targets.alias("t").join(hint(cuts.alias("c")), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    plan = materialize(plan.select("t.*", F.coalesce("c.cut", F.lit(-1)).alias("cut")), "mix-plan")

    z, n, c, k = (fresh(docs, x) for x in ("draw", "size", "cut", "plan"))
    own = docs.select(*[F.col(f"`{x}`") for x in rest], size.alias(n), u.alias(z)).alias("d")
    own = own.join(hint(plan.alias("t")), F.col(f"d.`{source}`").eqNullSafe(F.col("t.source")), "left")
    e = expected("t")
    own = own.select(*[F.col(f"d.`{x}`") for x in rest], F.col(f"d.{n}"), F.col(f"d.{z}"), F.struct("t.source_size", "t.target", F.col("t.cut").alias("cut"), *[v.alias(x) for x, v in e.items()]).alias(k))
    hit = F.coalesce((pareto_rank(F.col(z), F.col(k)["share"]) <= F.col(k)["cut"]).cast("long"), F.lit(0))
    own = own.withColumn(c, F.col(k)["certain"] + hit)
    made = [F.col(n), F.col(k)["source_size"], F.col(k)["target"], F.col(c), F.col(c) * F.col(n)]
    return own.select(*[F.col(f"`{x}`") for x in rest], *[v.alias(x) for x, v in zip(mine, made, strict=True)])
