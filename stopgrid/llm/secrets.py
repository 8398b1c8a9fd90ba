r"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: alternatives are joined by OR, what must occur by AND.
The index has a posting (trigram, document) for each trigram that some rule asks for and each document that holds it; postings are
intersected by document, and only documents that satisfy a rule's query are matched against its expression. A rule of which no
trigram is mandatory ([0-9a-f]+) is matched against every document.

Matches are leftmost and do not overlap within a kind; those whose value is shorter than the rule's least length are dropped after
matching, so what they used up stays used up. Positions are code points, the end exclusive. Null texts are empty and have none.
Rows are kept as they are, repeated ones too (a row is told apart by doc_id and its text); other columns are not read.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, text_of, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length.
    group: int = 0
    least: int = 0
    #: A cheaper expression that matches somewhere if a match of sufficient length does; for rules without trigrams.
    probe: str | None = None


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])
MOST = 64


def _exact(item: tuple) -> set[str] | None:
    """All strings that a part of an expression matches, if they are few."""
    op, av = item
    if op is sre.LITERAL:
        return {chr(av)}
    if op is sre.IN and av[0][0] is not sre.NEGATE:
        out: set[str] = set()
        for kind, x in av:
            if kind is sre.LITERAL:
                out.add(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out |= set(map(chr, range(x[0], x[1] + 1)))
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_all(av[3])
    if op is sre.BRANCH:
        parts = [_exact_all(x) for x in av[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[1] <= 3:
        one = _exact_all(av[2])
        return None if one is None else {"".join(x) for n in range(av[0], av[1] + 1) for x in product(one, repeat=n)}
    return None


def _exact_all(items) -> set[str] | None:  # noqa: ANN001
    out = {""}
    for x in items:
        if (one := _exact(x)) is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _least(c: set[frozenset[str]]) -> Clauses:
    """Without clauses that ask for more than another."""
    return frozenset(x for x in c if not any(y < x for y in c))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _least({x | y for x in a for y in b})


def _grams(strings: set[str]) -> Clauses:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _query(items) -> Clauses:  # noqa: ANN001
    found, run = ANY, {""}
    for item in [*items, None]:
        one = None if item is None else _exact(item)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        found, run = _both(found, _grams(run)), one or {""}
        if item is not None and one is None:
            op, av = item
            if op is sre.SUBPATTERN:
                found = _both(found, _query(av[3]))
            elif op is sre.BRANCH:
                found = _both(found, _least(set().union(*(_query(x) for x in av[1]))))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0] >= 1:
                found = _both(found, _query(av[2]))
    return found


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams: a text with a match holds all trigrams of one clause. {{}} if nothing is mandatory."""
    flags = re.I if pattern.startswith("(?i)") else 0
    tree = parser.parse(pattern.removeprefix("(?i)"), flags)
    return _least({frozenset(g.lower() for g in c) for c in _query(tree)})


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches of sufficient length."""
    full, cut = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else full
    each = F.arrays_zip(F.transform(cut, F.length).alias("gap"), F.transform(full, F.length).alias("len"), F.transform(value, F.length).alias("own"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.filter(each, lambda x: x["len"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda acc: acc["found"])


def _named(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: gram (its number), doc_id and row key, for the grams asked for."""
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(low.contains(g), F.lit(i)) for i, g in enumerate(grams))))
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.explode(held).alias("gram"))


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and, in ``found``, kind, start and end of every match, by start and then in the rules' order."""
    docs = text_of(df)
    queries = {r: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if frozenset() not in queries[r]]
    grams = sorted({g for r in indexed for c in queries[r] for g in c})
    words = range(-(-len(grams) // 62))
    place = {g: divmod(i, 62) for i, g in enumerate(grams)}
    row = F.xxhash64("text")
    joined = docs.withColumn("row", row)
    if indexed:
        held = postings(docs, grams).groupBy("doc_id", "row").agg(*(F.bit_or(F.expr(f"if(gram div 62 = {k}, shiftleft(1L, gram % 62), 0L)")).alias(f"mask{k}") for k in words))

        def meets(r: Rule) -> Column:
            masks = [[sum(1 << place[g][1] for g in c if place[g][0] == k) for k in words] for c in sorted(queries[r], key=sorted)]
            every = [reduce(lambda a, b: a & b, (F.col(f"mask{k}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for k, m in enumerate(c) if m)) for c in masks]
            return reduce(lambda a, b: a | b, every)

        candidates = held.select(F.col("doc_id").alias("d"), F.col("row").alias("w"), F.array_compact(F.array(*(F.when(meets(r), F.lit(r.kind)) for r in indexed))).alias("kinds")).where(F.size("kinds") > 0)
        # few texts are candidates of an indexed rule: only those meet the index again, the others stay where they are read
        candidates = written(candidates, "candidates")
        split = hinted(joined, F.col("row"), candidates.select("w"), candidates.count(), "may")
        met = split.where("may").join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("w")), "left").select("doc_id", "text", "kinds")
        joined = met.unionByName(split.where("not may").select("doc_id", "text", F.expr("cast(null as array<string>)").alias("kinds")))
    else:
        joined = joined.withColumn("kinds", F.expr("cast(null as array<string>)"))
    text, none = F.col("text"), F.expr("cast(array() as array<struct<start:int,end:int>>)")
    all_of = []
    for i, r in enumerate(rules):
        scanned = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r in indexed else text.rlike(r.probe or r.pattern)
        own = F.when(scanned, matches(text, r)).otherwise(none)
        all_of.append(_named(own, i, r.kind))
    return joined.select("doc_id", F.array_sort(F.concat(*all_of)).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    spelled = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
