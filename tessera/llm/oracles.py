"""SQL of the operators that SQL can express, for another engine to run on the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: All alignments of a document and an item, without seeds: a brute-force version.
DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM (SELECT doc_id, {WORDS} AS w FROM documents) x),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM (SELECT item_id, {WORDS} AS w FROM benchmark) x WHERE len(w) >= 5),
m AS (SELECT DISTINCT d.doc_id, i.item_id, i.n, d.p - i.p AS diag, i.p AS ip FROM d JOIN i USING (t)),
dense AS (SELECT doc_id, item_id, diag FROM m GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT doc_id, item_id, diag, least(n, 13) AS compared, unnest(range(greatest(0, ip - least(n, 13) + 1), least(ip, n - least(n, 13)) + 1)) AS i FROM m JOIN dense USING (doc_id, item_id, diag)),
c AS (SELECT doc_id, item_id, i + diag AS start, compared, count(*) AS matched FROM s GROUP BY doc_id, item_id, diag, i, compared),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start, compared DESC) AS k FROM c WHERE matched >= ceil(compared * 0.69) AND matched >= 5)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(matched AS BIGINT) AS matched, CAST(compared AS BIGINT) AS compared FROM r WHERE k = 1
"""


def _weights(level: str, weights: dict[str, dict[str, float]]) -> str:
    given = weights.get(level)
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1.0 END" if given else "1.0"


def _share(source: str, parent: list[str], budget: str, out: str, order: list[str]) -> str:
    """Each child's part of the budget: the level of the first child, by capacity per weight, that need not be filled."""
    by = "PARTITION BY " + ", ".join(parent) if parent else ""
    line = f"{by} ORDER BY r ASC NULLS LAST, {', '.join(order)}"
    return f"""SELECT * EXCLUDE (r, f, l, v), CASE WHEN v IS NULL THEN CAST(capacity AS DOUBLE) ELSE least(CAST(capacity AS DOUBLE), v * w) END AS {out} FROM (
  SELECT *, first_value(CASE WHEN l > 0 AND f + r * l >= {budget} THEN ({budget} - f) / l END IGNORE NULLS) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM (
    SELECT *, coalesce(sum(capacity) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, sum(w) OVER ({by}) - coalesce(sum(w) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM (
      SELECT *, CAST(capacity AS DOUBLE) / w AS r FROM ({source}) a) b) c) d"""


def mix(fraction: float, weights: dict[str, dict[str, float]], epochs: int, seed: int = 7, domains: int = 4) -> str:
    """The mix, each leaf by one running sum over its epochs; for positive weights."""
    top = f"SELECT domain, sum(tokens) * {epochs} AS capacity, CAST({_weights('domain', weights)} AS DOUBLE) AS w, (SELECT sum(n_tokens) FROM r0) * CAST({fraction} AS DOUBLE) AS b0 FROM leaves GROUP BY 1"
    mid = f"SELECT l.domain, l.lang, sum(tokens) * {epochs} AS capacity, CAST({_weights('lang', weights)} AS DOUBLE) AS w, b1 FROM leaves l JOIN t1 ON t1.domain = l.domain GROUP BY l.domain, l.lang, b1"
    low = f"SELECT l.domain, l.lang, l.source, tokens * {epochs} AS capacity, CAST({_weights('source', weights)} AS DOUBLE) AS w, b2 FROM leaves l JOIN t2 ON t2.domain = l.domain AND t2.lang = l.lang"
    return rf"""
WITH r0 AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  'domain' || CAST((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % {domains} AS VARCHAR) AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM r0 GROUP BY ALL),
t1 AS ({_share(top, [], 'b0', 'b1', ['domain'])}),
t2 AS ({_share(mid, ['domain'], 'b1', 'b2', ['domain', 'lang'])}),
t3 AS (SELECT domain, lang, source, CAST(floor(round(b3, 6)) AS BIGINT) AS budget FROM ({_share(low, ['domain', 'lang'], 'b2', 'b3', ['domain', 'lang', 'source'])}) x),
e AS (SELECT r0.*, epoch, md5('{seed}:' || CAST(epoch AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM r0, (SELECT CAST(unnest(range(0, {epochs})) AS INT) AS epoch) n),
s AS (SELECT e.*, t3.budget, sum(n_tokens) OVER (PARTITION BY e.domain, e.lang, e.source ORDER BY epoch, h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e JOIN t3 ON t3.domain = e.domain AND t3.lang = e.lang AND t3.source = e.source)
SELECT doc_id, epoch, domain, lang, source, n_tokens, budget FROM s WHERE upto <= budget
"""
