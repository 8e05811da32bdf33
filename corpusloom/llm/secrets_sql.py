"""DuckDB SQL for the secret scan: every rule over every text, no index."""
from __future__ import annotations

from .secrets import BASE, RULES


def _rule(i: int, r) -> str:
    x = r.regex.replace("'", "''")
    return f"""
    (SELECT list(struct_pack(s := s, r := {i}, t := '{r.kind}:' || s || ':' || e)) FILTER (WHERE n >= {r.least}) FROM (
      SELECT unnest(range(1, len(m) + 1)) AS i, m, g, b,
        list_sum(list_transform(b[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0) AS s,
        s + len(m[i]) AS e, len(g[i]) AS n
      FROM (SELECT regexp_extract_all(x, '{x}') AS m, regexp_extract_all(x, '{x}', {r.group}) AS g, string_split_regex(x, '{x}') AS b))) AS s{i}"""


def sql() -> str:
    every = "list_concat(" * (len(RULES) - 1) + "coalesce(s0, [])" + "".join(f", coalesce(s{i}, []))" for i in range(1, len(RULES)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
f AS (SELECT doc_id, {','.join(_rule(i, r) for i, r in enumerate(RULES))} FROM d),
a AS (SELECT doc_id, list_sort({every}) AS a FROM f)
SELECT doc_id,
  {', '.join(f"CAST(len(list_filter(a, lambda y: y.r = {i})) AS BIGINT) AS n_{r[0]}" for i, r in enumerate(BASE))},
  sha256(array_to_string(list_transform(list_filter(a, lambda y: y.r < {len(BASE)}), lambda y: y.t), ',')) AS base_sha256,
  array_to_string(list_transform(a, lambda y: y.t), ',') AS spans
FROM a"""
