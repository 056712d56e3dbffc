r"""Secret scan through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of alternatives,
each the trigrams that a match must contain. The index holds one posting (trigram, key) for each
trigram of any query and each document with it. Intersecting the postings of an alternative gives
its candidates; only these are read with the regular expression. A rule without mandatory trigrams
reads every document.

Everything runs as column expressions and joins. Places are counted in code points, the end is
exclusive. Null texts are empty; null keys are a key of their own; rows with the same key share
candidates, but each is verified on its own text, so results stay exact. Columns besides the key and
the text are not read.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize

#: Alternatives of a query beyond this are not spelled out.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to find, the group that is the value, and how long the value must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Public formats of further credentials.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + FURTHER


def _strings(node) -> set[str] | None:
    """The strings that a node matches, lower-cased, if they are few."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                found.add(chr(value).lower())
            elif kind is rc.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[1] != rc.MAXREPEAT and arg[1] <= 2:
        body = _sequence(arg[2])
        if body is None:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(body, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _either(alternatives) -> list[frozenset[str]]:
    """Alternatives without those that another one implies."""
    unique = set(alternatives)
    return sorted((a for a in unique if not any(b < a for b in unique)), key=sorted)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that every match contains; ``[frozenset()]`` if there are none."""

    def query(nodes) -> list[frozenset[str]]:
        clauses, run = [frozenset()], {""}

        def both(other: list[frozenset[str]]) -> None:
            nonlocal clauses
            joined = _either(a | b for a in clauses for b in other)
            if len(joined) <= MOST_STRINGS:
                clauses = joined

        for node in nodes:
            more = _strings(node)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            both(_either(_grams(s) for s in run))
            run = more if more is not None else {""}
            if more is None:
                op, arg = node
                if op is rc.SUBPATTERN:
                    both(query(arg[3]))
                elif op is rc.BRANCH:
                    both(_either(c for part in arg[1] for c in query(part)))
                elif op is rc.MAX_REPEAT and arg[0] > 0:
                    both(query(arg[2]))
        both(_either(_grams(s) for s in run))
        return clauses

    return query(rp.parse(pattern))


def postings(docs: DataFrame, grams: list[str], key: str, text: str) -> DataFrame:
    """One row (gram number, key) for each listed trigram that a text has, in either case."""
    present = F.array(*[F.when(F.contains(F.col("lowered"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
    # A column of its own below the explode, so that a text is lower-cased once and not for each trigram.
    lowered = docs.select(F.col(key).alias("doc"), F.lower(F.col(text)).alias("lowered"))
    return lowered.select("doc", F.explode(F.array_compact(present)).alias("gram"))


def candidates(index: DataFrame, grams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Keys with a bit for each rule for which the postings of some alternative all hold the key.

    An alternative's postings are intersected by OR-ing a bit for each of its trigrams, which is
    combined before the shuffle.
    """
    number = {g: i for i, g in enumerate(grams)}
    places: dict[int, list[tuple[int, int]]] = {}
    whole, rule_of = [], []
    for r, rule in enumerate(rules):
        for alternative in trigram_query(rule.pattern):
            if alternative:
                for bit, gram in enumerate(sorted(alternative)):
                    places.setdefault(number[gram], []).append((len(whole), 1 << bit))
                whole.append((1 << len(alternative)) - 1)
                rule_of.append(1 << r)
    rows = [F.array(*[F.struct(F.lit(a).alias("alt"), F.lit(b).cast("long").alias("bit")) for a, b in places[i]]) for i in range(len(grams))]
    per = index.select("doc", F.explode(F.element_at(F.array(*rows), F.col("gram") + 1)).alias("p"))
    seen = per.groupBy("doc", F.col("p.alt").alias("alt")).agg(F.bit_or("p.bit").alias("seen"))
    full = F.element_at(F.array(*[F.lit(w).cast("long") for w in whole]), F.col("alt") + 1)
    rule = F.element_at(F.array(*[F.lit(b).cast("long") for b in rule_of]), F.col("alt") + 1)
    return seen.where(F.col("seen") == full).groupBy("doc").agg(F.bit_or(rule).alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's matches, leftmost first and without overlap.

    The pieces between matches and the matches themselves alternate, so running lengths give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)),
        F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("all"), F.length(v).alias("value"))),
        lambda g, h: F.struct(F.length(g).alias("gap"), h["all"].alias("all"), h["value"].alias("value")),
    )
    empty = F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + x["all"]).alias("end"))
        kept = F.when(x["value"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((start + x["all"]).alias("at"), kept.alias("out"))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(lengths, first, step, lambda s: s["out"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``found``, the spans (start, order, kind, end) of all rules, one row per row of ``docs``."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*(a for q in queries for a in q)))
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if grams:
        index = materialize(postings(docs, grams, key, text), "postings")
        picked = candidates(index, grams, rules).withColumnRenamed("doc", "doc_hit")
        rows = rows.join(picked, F.col("doc").eqNullSafe(F.col("doc_hit")), "left").drop("doc_hit")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    found = []
    for order, (rule, query) in enumerate(zip(rules, queries)):
        spans = spans_of(F.col("body"), rule, order)
        if frozenset() not in query:
            spans = F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << order)) != 0, spans)
            spans = F.coalesce(spans, F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)"))
        found.append(spans)
    return rows.select(F.col("doc").alias(key), F.array_sort(F.concat(*found)).alias("found"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["order"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda s: s["order"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
