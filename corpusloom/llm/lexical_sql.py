"""Ranked lexical search (12) as DuckDB SQL."""

_TERMS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
 held AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
 whole AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM held WHERE len(terms) > 0),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs),
 m AS (SELECT doc_id, 100 - 25 + (25 * len(terms) * n_docs) // length AS m FROM held, whole WHERE len(terms) > 0),
 scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY ALL)
 SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""
