"""Secret scan: Boolean trigram queries derived from each rule's regex select candidates, which the regex verifies.

``trigram_query`` turns a regex into a disjunction of trigram sets, one of which any match must contain. The index
keeps, beside each document, the posting bits of exactly the trigrams that some rule asks for: bit g of a row is
set if trigram g posts to that row, so the postings of a trigram are one bit column over all rows, and
intersecting or uniting postings is bit arithmetic without a shuffle. Only candidate rows are verified, and rules
without mandatory trigrams scan every row. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let


@dataclass(frozen=True)
class SecretRule:
    """Spans are the leftmost non-overlapping matches of ``pattern``; of these, ones whose ``group`` is shorter than
    ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules of the op5 contract (hex and access take the length into the pattern, which gives the
#: same spans because their runs are maximal), then formats of public token types.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("npm", r"npm_[A-Za-z0-9]{36}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    SecretRule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

ANY = frozenset([frozenset()])
_MOST = 64


def _absorb(query: frozenset) -> frozenset:
    """Drop conjunctions that another one implies: a | (a & b) = a."""
    return frozenset(c for c in query if not any(o < c for o in query))


def _and(a: frozenset, b: frozenset) -> frozenset:
    both = _absorb(frozenset(x | y for x in a for y in b))
    return both if len(both) <= _MOST else a


def _strings_query(strings: set[str]) -> frozenset:
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _one(op, arg) -> tuple[set[str] | None, frozenset]:
    """(all strings the element can match, or None if too many; a query that any match satisfies)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(v).lower() for _, v in arg}, ANY
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANY
        return None, _absorb(frozenset().union(*(_and(q, _strings_query(s)) if s else q for s, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most == 1 and least == 0:
            return strings | {""}, ANY
        if strings is not None and least == most and len(strings) ** least <= _MOST:
            return reduce(lambda a, _: {x + y for x in a for y in strings}, range(least), {""}), ANY
        return None, (query if strings is None else _strings_query(strings)) if least else ANY
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, frozenset]:
    exact, query, run = True, ANY, {""}
    for op, arg in items:
        strings, sub = _one(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        exact, query, run = False, _and(_and(query, _strings_query(run)), sub), strings or {""}
    return (run, ANY) if exact else (None, _and(query, _strings_query(run)))


def trigram_query(pattern: str) -> frozenset:
    """A disjunction (set) of conjunctions (sets of lower-case trigrams); ``{{}}`` where nothing is mandatory."""
    strings, query = _sequence(sre.parse(pattern))
    return query if strings is None else _strings_query(strings)


def trigram_index(docs: DataFrame, text: str, queries: list[frozenset]) -> tuple[DataFrame, dict[str, tuple[str, int]]]:
    """Add the posting bits of all trigrams of ``queries`` (63 to a column); also returns trigram -> (column, bit)."""
    grams = sorted({g for q in queries for c in q for g in c})
    lower = fresh(docs, "lower")
    low = docs.withColumn(lower, F.lower(F.col(f"`{text}`")))
    at, columns = {}, {}
    for block in range(0, len(grams), 63):
        name = fresh(docs, f"grams{block // 63}_")
        bits = F.lit(0).cast("long")
        for i, g in enumerate(grams[block : block + 63]):
            at[g] = (name, i)
            bits = bits.bitwiseOR(F.when(F.contains(F.col(lower), F.lit(g)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        columns[name] = bits
    return low.withColumns(columns).drop(lower), at


def candidate(query: frozenset, at: dict[str, tuple[str, int]]) -> Column:
    """Whether a row's posting bits satisfy the query."""
    out = F.lit(False)
    for clause in sorted(query, key=sorted):
        masks: dict[str, int] = {}
        for g in clause:
            masks[at[g][0]] = masks.get(at[g][0], 0) | 1 << at[g][1]
        hit = F.lit(True)
        for name, mask in sorted(masks.items()):
            hit = hit & (F.col(name).bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        out = out | hit
    return out


def running(a: Column, join, width: int = 128) -> Column:
    """Inclusive running values of an array of numbers under ``join`` (sum, maximum), by blocks, so that long arrays
    don't cost their square."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(None).cast("long"), lambda s, v: F.when(s.isNull(), v.cast("long")).otherwise(join(s, v.cast("long"))))

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: F.slice(x, b * width + 1, F.lit(width)))

        def with_totals(y: Column) -> Column:  # struct(blocks, totals)
            def inside(block: Column, i: Column) -> Column:
                def of_block(before: Column) -> Column:
                    own = F.transform(block, lambda _, j: total(F.slice(block, F.lit(1), j + 1)))
                    return F.when(before.isNull(), own).otherwise(F.transform(own, lambda v: join(before, v)))

                return let(total(F.slice(y["totals"], F.lit(1), i)), of_block)

            return F.flatten(F.transform(y["blocks"], inside))

        return let(let(blocks, lambda b: F.struct(b.alias("blocks"), F.transform(b, total).alias("totals"))), with_totals)

    return F.when(F.size(a) > 0, let(a, of)).otherwise(F.array().cast("array<bigint>"))


_SPAN = "array<struct<start:bigint,no:int,kind:string,end:bigint>>"


def find_spans(text: Column, rule: SecretRule, no: int) -> Column:
    """Spans of a rule as array of struct(start, no, kind, end), in code points, end exclusive."""

    def of(x: Column) -> Column:  # struct(found, lens, pieces)
        gaps = F.transform(F.slice(x["pieces"], F.lit(1), F.size(x["found"])), F.length)
        ends = running(F.zip_with(F.transform(x["found"], F.length), gaps, lambda a, b: (a + b).cast("long")), lambda a, b: a + b)
        spans = F.transform(
            F.arrays_zip(ends.alias("end"), x["found"].alias("m"), x["kept"].alias("kept")),
            lambda z: F.struct((z["end"] - F.length(z["m"])).alias("start"), F.lit(no).alias("no"), F.lit(rule.kind).alias("kind"), z["end"].alias("end"), (F.length(z["kept"]) >= rule.least).alias("ok")),
        )
        return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["no"], s["kind"], s["end"]))

    p = F.lit(rule.pattern)
    parts = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("kept"), F.split(text, rule.pattern).alias("pieces"))
    return F.when(text.rlike(rule.pattern), let(parts, of).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def scan_secrets(docs: DataFrame, text: str = "text", rules=RULES, column: str = "spans") -> DataFrame:
    """Add ``column``: array of struct(start, no, kind, end), ordered by start, then rule; such a column is replaced.

    Null and empty texts have no spans; whole texts are searched, whatever their length; every row is judged by
    itself, so repeated rows get equal spans and an empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    rest = [c for c in docs.columns if c.lower() != column.lower() or c == text]
    whole = fresh(docs, "text")
    base = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole))
    indexed, at = trigram_index(base, whole, list(queries.values()))
    none = F.array().cast(_SPAN)
    found = [F.when(candidate(queries[r.kind], at), find_spans(F.col(whole), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return indexed.select(*[F.col(f"`{c}`") for c in rest], F.array_sort(F.flatten(F.array(*found))).alias(column))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _merged(spans: Column) -> Column:
    """Disjoint struct(start, end) of sorted spans; overlapping ones become one, touching ones do not."""

    def of(x: Column) -> Column:  # struct(s: spans, m: running maxima of their ends)
        starts = F.filter(F.transform(x["s"], lambda s, i: F.when((i == 0) | (s["start"] >= F.get(x["m"], i - 1)), s["start"])), lambda v: v.isNotNull())
        ends = F.filter(F.transform(x["m"], lambda m, i: F.when((i == F.size(x["m"]) - 1) | (F.get(x["s"], i + 1)["start"] >= m), m)), lambda v: v.isNotNull())
        return F.arrays_zip(starts.alias("start"), ends.alias("end"))

    return let(F.struct(spans.alias("s"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("m")), of)


#: Characters of a text that are cut at once when secrets are replaced.
_CUT = 4096


def redact(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Replace every secret span of ``text`` by ``[SECRET]``; overlapping spans become one. Nulls stay null.

    The text column is replaced; all others stay, whatever their names. A text is cut into blocks of ``_CUT`` characters,
    so that long texts with many secrets don't cost their square.
    """
    spans = fresh(docs, "spans")
    marked = scan_secrets(docs, text, rules, spans)

    def glue(x: Column) -> Column:  # struct(m: merged spans, blocks)
        def block(b: Column, j: Column) -> Column:
            lo = j * _CUT
            hi = lo + F.length(b)
            part = lambda a, z: F.substring(b, (a - lo + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))

            def pieces(own: Column) -> Column:
                before = lambda i: F.greatest(F.coalesce(F.get(own, i - 1)["end"], lo), lo)
                cut = F.transform(own, lambda s, i: F.concat(part(F.when(i > 0, before(i)).otherwise(lo), s["start"]), F.when(s["start"] >= lo, F.lit("[SECRET]")).otherwise(F.lit(""))))
                return F.concat(F.array_join(cut, ""), part(F.when(F.size(own) > 0, F.least(F.element_at(own, -1)["end"], hi)).otherwise(lo), hi))

            own = F.filter(x["m"], lambda s: (s["start"] < hi) & (s["end"] > lo))
            return F.when(F.exists(x["m"], lambda s: (s["start"] < hi) & (s["end"] > lo)), let(own, pieces)).otherwise(b)

        return F.array_join(F.transform(x["blocks"], block), "")

    t = F.col(f"`{text}`")
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    new = let(F.struct(_merged(F.col(spans)).alias("m"), blocks.alias("blocks")), glue)
    return marked.withColumn(text, F.when(F.size(spans) > 0, new).otherwise(t)).drop(spans)
