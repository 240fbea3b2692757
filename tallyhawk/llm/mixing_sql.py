"""The mixture of ``mixing`` as DuckDB SQL."""

from __future__ import annotations

LEVELS = ("domain", "lang", "source")


def _weight(level: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items())
    return f"CAST(CASE {level} {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"


def _level(depth: int, weights: dict[str, dict[str, int]], max_epochs: int, budget: str) -> str:
    name, above = LEVELS[depth], LEVELS[:depth]
    keys = ", ".join((*above, name))
    own = f"s{depth}"
    siblings = f"PARTITION BY {', '.join(above)}" if above else ""
    rate = f"{siblings} ORDER BY capacity::DOUBLE / weight, {name}"
    given = f"(SELECT {budget} FROM leaves)" if not depth else f"s{depth - 1}.share"
    source = f"n{depth}" if not depth else f"n{depth} JOIN s{depth - 1} USING ({', '.join(above)})"
    return f"""
n{depth} AS (SELECT * FROM (SELECT {keys}, CAST(sum(supply) * {max_epochs} AS BIGINT) AS capacity, {_weight(name, weights.get(name, {}))} AS weight
  FROM leaves GROUP BY {keys}) WHERE weight > 0 AND capacity > 0),
g{depth} AS (SELECT {keys}, capacity, weight, CAST({given} AS BIGINT) AS budget FROM {source}),
f{depth} AS (SELECT *, weight * (budget - sum(capacity) OVER ({rate} ROWS UNBOUNDED PRECEDING))
  >= capacity * coalesce(sum(weight) OVER ({rate} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS filled FROM g{depth}),
r{depth} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({siblings}), 0) AS spent,
  sum(CASE WHEN NOT filled THEN weight END) OVER ({siblings}) AS open FROM f{depth}),
{own} AS (SELECT {keys}, CAST(CASE WHEN filled THEN capacity ELSE least(capacity, ((budget - spent) * weight) // open) END AS BIGINT) AS share FROM r{depth})"""


def mixture(domain: str, weights: dict[str, dict[str, int]], budget: str, max_epochs: int, seed: int) -> str:
    """SQL for ``mixing.mixed`` on the table ``documents``; ``domain`` and ``budget`` are SQL expressions."""
    keys = ", ".join(LEVELS)
    levels = ",".join(_level(d, weights, max_epochs, budget) for d in range(3))
    return f"""
WITH slim AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT {keys}, sum(tokens) AS supply FROM slim GROUP BY {keys}),{levels},
plan AS (SELECT {keys}, CAST(share // supply AS INTEGER) AS epochs, CAST(share % supply AS BIGINT) AS rest
  FROM s2 JOIN leaves USING ({keys})),
placed AS (SELECT slim.*, epochs, rest, md5(concat_ws(':', '{seed}', epochs, coalesce(CAST(doc_id AS VARCHAR), ''))) AS place FROM slim JOIN plan USING ({keys})),
started AS (SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY place) - sum(tokens) OVER (PARTITION BY {keys}, place) AS start FROM placed),
taken AS (SELECT *, epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS reach FROM started),
repeated AS (SELECT *, unnest(range(reach)) AS epoch FROM taken WHERE reach > 0)
SELECT doc_id, {keys}, tokens, CAST(epoch AS INTEGER) AS epoch,
  CAST(CASE WHEN epoch = epochs AND start = max(CASE WHEN epoch = epochs AND tokens > 0 THEN start END) OVER (PARTITION BY {keys}) THEN least(tokens, rest - start) END AS BIGINT) AS cut_tokens
FROM repeated
"""
