"""URL filter: log-likelihood ratio of two smoothed variable-order character Markov models.

One model is fitted to accepted URLs, one to rejected URLs. A character's probability is interpolated
(Witten-Bell) over all contexts of 0 to ``order`` preceding characters that the model has seen. A URL's score is
the difference of its log-likelihoods under the two models divided by its number of symbols, and a threshold
calibrated on held-out labelled URLs turns the score into a verdict.

Everything is DataFrame work: positions are exploded once per distinct URL, the model tables (all grams of all labelled URLs
that don't calibrate) are broadcast after a check of their size, and partial sums leave one row per URL for the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, ASCII_UPPER, fresh, materialize

HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the op1 contract.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST_PATH, 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest rule whose host equals or is a parent of ``host`` and whose path starts ``path``; else null."""
    out = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out.append(F.when(fits, F.lit(r.name)))
    return F.coalesce(*out, F.lit(None).cast("string"))


def rule_verdict(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*[F.when(rule == r.name, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))


@dataclass(frozen=True)
class MarkovConfig:
    """``alphabet``: number of symbols of the uniform base distribution."""

    order: int = 3
    alphabet: int = 256


#: Model tables up to this number of rows are broadcast; larger ones, of very long URLs, are joined by a shuffle.
BROADCAST_GRAMS = 2_000_000


@dataclass
class MarkovRatio:
    config: MarkovConfig
    grams: DataFrame  # gram, n (its length), a, r, and as a context ca, ta, cr, tr
    root: tuple
    threshold: float


def _positions(urls: DataFrame, url: str, order: int) -> DataFrame:
    """One row per symbol of each URL with its grams g1 .. g(order+1), all ending at the symbol."""
    padded = F.concat(F.lit("\u0002" * order), F.lower(F.col(url)), F.lit("\u0003"))
    grams = urls.select(*urls.columns, padded.alias("__s")).select(
        *urls.columns, "__s", F.explode(F.sequence(F.lit(order + 1), F.length("__s"))).alias("__i")
    )
    return grams.select(*urls.columns, *[F.substring(F.col("__s"), F.col("__i") - F.lit(k - 1), F.lit(k)).alias(f"g{k}") for k in range(1, order + 2)],
                        *[F.substring(F.col("__s"), F.col("__i") - F.lit(k), F.lit(k)).alias(f"h{k}") for k in range(1, order + 1)])


def fold_of(url: Column) -> Column:
    """0 to 3, by MD5: fold 0 calibrates."""
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % 4


def fit_markov_ratio(labelled: DataFrame, config: MarkovConfig | None = None) -> MarkovRatio:
    """Fit on all of ``labelled`` (url, accepted boolean). Null URLs are ignored; a class without URLs has an empty model.

    A quarter of the URLs (by hash) calibrates the threshold: the cut with the largest sum of the two classes' hit
    rates, the lowest such cut on ties, midway between the scores at either side; 0 if a class is absent from it.
    """
    config = config or MarkovConfig()
    k = config.order + 1
    base = labelled.filter(F.col("url").isNotNull() & F.col("accepted").isNotNull()).select("url", "accepted").distinct()
    base = materialize(base.withColumn("fold", fold_of(F.col("url"))), "url-labels")

    longest = (
        _positions(base.filter("fold <> 0"), "url", config.order)
        .groupBy(F.col(f"g{k}").alias("longest"))
        .agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    )
    # All grams of a symbol end at it, so the shorter ones are ends of the longest and counted from its counts.
    counts = (
        longest.select("a", "r", F.explode(F.array(*[F.substring(F.col("longest"), F.lit(k + 1 - j), F.lit(j)) for j in range(1, k + 1)])).alias("gram"))
        .groupBy("gram")
        .agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        .withColumn("n", F.length("gram"))
    )
    counts = materialize(counts, "url-grams")
    contexts = (
        counts.withColumn("gram", F.substring(F.col("gram"), F.lit(1), F.col("n") - 1))
        .groupBy("gram")
        .agg(F.sum("a").alias("ca"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("cr"), F.count_if(F.col("r") > 0).alias("tr"))
    )
    model = counts.join(contexts, "gram", "left").na.fill(0, ["ca", "ta", "cr", "tr"])
    # A context starts with padding at most, so it need not occur as a gram itself.
    pads = contexts.join(counts.select("gram"), "gram", "left_anti").filter(F.length("gram") > 0)
    model = model.unionByName(pads.withColumns({"n": F.length("gram"), "a": F.lit(0).cast("long"), "r": F.lit(0).cast("long")}).select(model.columns))
    model = materialize(model, "url-model")
    root = model.filter("n = 1").agg(F.sum("a"), F.count_if(F.col("a") > 0), F.sum("r"), F.count_if(F.col("r") > 0)).first()
    out = MarkovRatio(config, model, tuple(int(x or 0) for x in root), 0.0)

    held = base.filter("fold = 0")
    out.threshold = best_cut(score_urls(held.select("url").distinct(), out).join(held.select("url", "accepted"), "url"))
    return out


def best_cut(scored: DataFrame) -> float:
    """The cut of rows (score, accepted) that ``fit_markov_ratio`` describes; 0 if a class is absent.

    Scores are dealt by range; sums per range, of which there are few, give what lies below each.
    """
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = scored.groupBy("score").agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    counts = materialize(counts.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()), "url-scores")
    before, all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row per range
    ranges = counts.groupBy("part").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.max("score").alias("top"))
    ranges = ranges.select(
        "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("a", "r")], F.max("top").over(before).alias("top0"),
        *[F.sum(c).over(all_parts).alias(f"all_{c}") for c in ("a", "r")],
    )
    own = Window.partitionBy("part").orderBy("score")
    w = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = (
        counts.join(F.broadcast(ranges), "part")
        .withColumns({"below_a": F.col("a0") + F.sum("a").over(w) - F.col("a"), "below_r": F.col("r0") + F.sum("r").over(w) - F.col("r"), "lower": F.coalesce(F.lag("score").over(own), "top0")})
        .filter("all_a > 0 and all_r > 0")
        .withColumn("gain", F.col("below_r") / F.col("all_r") - F.col("below_a") / F.col("all_a"))
        .orderBy(F.desc("gain"), "score")
        .select(((F.col("score") + F.coalesce("lower", "score")) / 2).alias("cut"))
        .first()
    )
    return float(best[0]) if best else 0.0


def score_urls(urls: DataFrame, model: MarkovRatio) -> DataFrame:
    """``urls``: distinct non-null column url. Returns (url, score).

    URLs are dealt anew to as many parts as shuffles have: they are small, but each makes many rows.
    """
    order, m = model.config.order, model.grams
    hint = F.broadcast if m.count() <= BROADCAST_GRAMS else (lambda df: df)
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = _positions(urls.repartition(parts, F.xxhash64("url")), "url", order)  # dealt by the URL itself, small parts would be merged
    for j in range(1, order + 2):
        t = m.filter(F.col("n") == j).select(F.col("gram").alias(f"g{j}"), F.col("a").alias(f"a{j}"), F.col("r").alias(f"r{j}"))
        out = out.join(hint(t), f"g{j}", "left")
    for j in range(1, order + 1):
        t = m.filter((F.col("n") == j) & (F.col("ca") + F.col("cr") > 0)).select(F.col("gram").alias(f"h{j}"), *[F.col(c).alias(f"{c}{j}") for c in ("ca", "ta", "cr", "tr")])
        out = out.join(hint(t), f"h{j}", "left")
    logs = []
    for c, cc, tt, (total, kinds) in (("a", "ca", "ta", model.root[:2]), ("r", "cr", "tr", model.root[2:])):
        p = F.lit(1.0 / model.config.alphabet)
        for j in range(1, order + 2):
            n = F.coalesce(F.col(f"{c}{j}"), F.lit(0))
            if j == 1:
                if total:
                    p = (n + F.lit(float(kinds)) * p) / F.lit(float(total + kinds))
            else:
                N, t = F.coalesce(F.col(f"{cc}{j - 1}"), F.lit(0)), F.coalesce(F.col(f"{tt}{j - 1}"), F.lit(0))
                p = F.when(N > 0, (n + t * p) / (N + t)).otherwise(p)
        logs.append(F.log(p))
    return out.select("url", (logs[0] - logs[1]).alias("d")).groupBy("url").agg(F.avg("d").alias("score"))


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, config: MarkovConfig | None = None) -> DataFrame:
    """Add host, path, rule, score and verdict to ``df``; columns of these names are replaced.

    The rules label the URLs on which the models are fitted. A URL that no rule fits gets the models' verdict:
    allow if its score reaches the threshold. A null URL has empty host and path, a null score, and is allowed.
    Repeated URLs are scored once. Without labelled URLs all scores are 0 and all verdicts allow. Other columns stay,
    whatever their names; an empty table gives an empty result.
    """
    own = F.col(f"`{url}`")
    mine = ["host", "path", "rule", "score", "verdict"]
    rest = [c for c in df.columns if c.lower() not in mine or c == url]
    u, v = fresh(df, "url"), fresh(df, "score")
    made = df.select(*[F.col(f"`{c}`") for c in rest], F.struct(url_host(own).alias("host"), url_path(own).alias("path")).alias(u))
    place = F.col(u)
    labelled = df.select(own.alias("url"), match_rule(url_host(own), url_path(own), rules).alias("rule")).filter("rule is not null")
    model = fit_markov_ratio(labelled.select("url", (rule_verdict(F.col("rule"), rules) == "allow").alias("accepted")), config)
    scores = score_urls(df.select(own.alias("url")).filter("url is not null").distinct(), model).toDF(f"{u}_", v)
    known = made.filter(own.isNotNull()).join(scores, own == F.col(f"{u}_"), "left").drop(f"{u}_")
    out = known.unionByName(made.filter(own.isNull()).withColumn(v, F.lit(None).cast("double")))
    rule = match_rule(place["host"], place["path"], rules)
    by_score = F.when(F.col(v) < F.lit(model.threshold), "block").otherwise("allow")
    verdict = F.coalesce(rule_verdict(rule, rules), by_score)
    new = (place["host"], place["path"], rule, F.col(v), verdict)
    return out.select(*[F.col(f"`{c}`") for c in rest], *[x.alias(n) for n, x in zip(mine, new, strict=True)])
