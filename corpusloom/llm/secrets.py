"""Secret scans (4), native: a trigram inverted index narrows the rules, regular expressions verify.

From each rule's expression a Boolean query over trigrams is derived (an OR of ANDs that every match must satisfy, in
lower case). The index holds, for the trigrams that occur in queries, the documents that contain them. Postings are
intersected per clause; a document is verified only against the rules whose query it satisfies. A rule whose
expression has no mandatory trigram is run over every text in full.
"""
from __future__ import annotations

import re._constants as c
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import texts

#: The base kinds of the contract, in its order: name, expression, group that is measured, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs, as [0-9a-f]+ with 24 or more
)
#: Public token formats that the method adds.
MORE = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("cloud_key", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
)


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int
    least: int


RULES = tuple(Rule(*x) for x in BASE + MORE)
ANY = frozenset([frozenset()])  # the query that all texts satisfy


def _least(query: frozenset) -> frozenset:
    return frozenset(x for x in query if not any(y < x for y in query))


def _trigrams(strings: set[str]) -> frozenset:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(regex: str) -> frozenset:
    """OR over clauses, each a set of lower-case trigrams that must all occur in a text with a match."""
    exact, query = _derive(parser.parse(regex))
    return query if exact is None else _trigrams(exact)


def _derive(items, most: int = 64) -> tuple[set[str] | None, frozenset]:
    """(all strings that it can match, if few; else None, what a match must contain)."""
    run, query, whole = {""}, ANY, True

    def both(a: frozenset, b: frozenset) -> frozenset:
        return _least(frozenset(x | y for x in a for y in b))

    def end_run() -> None:
        nonlocal run, query, whole
        query, run, whole = both(query, _trigrams(run)), {""}, False

    for op, arg in items:
        strings: set[str] | None = None
        must = ANY
        if op is c.LITERAL:
            strings = {chr(arg).lower()}
        elif op is c.IN:
            strings = {chr(x).lower() for kind, x in arg if kind is c.LITERAL} if all(kind is c.LITERAL for kind, _ in arg) else None
        elif op is c.SUBPATTERN:
            strings, must = _derive(arg[3])
        elif op is c.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                must = _least(frozenset(x for s, q in parts for x in (q if s is None else _trigrams(s))))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            once, needed = _derive(inner)
            if (low, high) == (0, 1) and once is not None:
                strings = once | {""}
            elif low:
                must = needed if once is None else _trigrams(once)
        elif op is c.AT:
            continue
        if strings is None or len(run) * len(strings) > most:
            end_run()
            query = both(query, must if strings is None else _trigrams(strings))
        else:
            run = {a + b for a in run for b in strings}
    if whole:
        return run, ANY
    return None, both(query, _trigrams(run))


def trigram_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings `(trigram, k)`: which documents contain which of the given trigrams, case dropped."""
    low = rows.select("k", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("k", F.explode(present).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`(k, kinds)`: the rules with a trigram query that a document satisfies."""
    clauses = [
        (rule.kind, n, t, len(clause))
        for rule in rules
        if (query := trigram_query(rule.regex)) != ANY
        for n, clause in enumerate(sorted(map(sorted, query)))
        for t in clause
    ]
    postings = trigram_index(rows, sorted({x[2] for x in clauses}))
    # one row for each trigram of a rule's clause: bounded by the rules, not by data
    wanted = F.broadcast(rows.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, need int"))
    met = postings.join(wanted, "trigram").groupBy("k", "kind", "clause", "need").agg(F.collect_set("trigram").alias("have"))
    return met.where(F.size("have") == F.col("need")).groupBy("k").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, wanted: Column) -> Column:
    """Array of (start, end) of the rule's leftmost non-overlapping matches of sufficient length; code points."""
    none = F.array().cast("array<string>")
    regex = F.lit(rule.regex)
    found = F.when(wanted, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none)
    measured = F.when(wanted, F.regexp_extract_all(text, regex, F.lit(rule.group))).otherwise(none) if rule.group else found
    # what lies before, between and behind the matches
    gaps = F.when(F.size(found) > 0, F.split(text, rule.regex, -1)).otherwise(none)
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), measured.alias("g"), F.slice(gaps, 1, F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["b"])).alias("start"),
                (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"),
                F.length(x["g"]).alias("size"),
            ))).alias("out"),
        ),
    )["out"]
    return F.filter(walked, lambda x: x["size"] >= rule.least)


def _ranked(spans: str, rank: int, kind: str) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`k, doc_id, spans` for every row: spans is an array of (start, rank, end, kind), rank being the rule's place.

    Code points, end exclusive, sorted by start and rank. A null text is empty and has no spans. Rows of the same key
    are verified each on its own text (the index may name a rule too many, never too few).
    """
    rows = texts(docs, doc_id, text)
    joined = rows.join(candidates(rows, rules), "k", "left")
    full = {r.kind for r in rules if trigram_query(r.regex) == ANY}
    # arrays per rule, then one sorted array
    per_rule = joined.select(
        "k", "doc_id",
        *[
            matches(F.col("text"), r, F.lit(True) if r.kind in full else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))).alias(f"s{i}")
            for i, r in enumerate(rules)
        ],
    )
    spans = F.array_sort(F.concat(*[
        _ranked(f"s{i}", i, r.kind) for i, r in enumerate(rules)
    ]))
    return per_rule.select("k", "doc_id", spans.alias("spans"))


def span_digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns: counts of the base kinds, sha256 of their spans, and all spans as text."""
    found = find_secrets(docs, **options)
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("spans")).alias("spans"),
    )
