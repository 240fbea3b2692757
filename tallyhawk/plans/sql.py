"""DuckDB forms of anchored windows and step chains, for the oracle queries."""

from __future__ import annotations

from tallyhawk.operators.match import Step
from tallyhawk.operators.windows import seconds

EVENTS = "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def us(expr: str) -> str:
    return f"CAST(epoch_us({expr}) AS BIGINT)"


def anchored(source: str, keys: list[str], dur: str, ts: str = "ts", order: str = "event_id", name: str = "w") -> str:
    """CTEs ending in ``name``: the source's columns with window_start and row_in_window. Starts with WITH RECURSIVE."""
    k = ", ".join(keys)
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM r.{c}" for c in keys)
    return f"""WITH RECURSIVE {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {ts}, {order}) AS rn FROM ({source})),
{name}_o AS (SELECT {k}, rn, {ts} AS t0, 1 AS n FROM {name}_r WHERE rn = 1
 UNION ALL SELECT {', '.join('r.' + c for c in keys)}, r.rn, CASE WHEN r.{ts} >= o.t0 + INTERVAL {seconds(dur)} SECOND THEN r.{ts} ELSE o.t0 END,
  CASE WHEN r.{ts} >= o.t0 + INTERVAL {seconds(dur)} SECOND THEN 1 ELSE o.n + 1 END
  FROM {name}_o o JOIN {name}_r r ON {same} AND r.rn = o.rn + 1),
{name} AS (SELECT r.*, o.t0 AS window_start, o.n AS row_in_window FROM {name}_r r JOIN {name}_o o ON {same} AND r.rn = o.rn)"""


def chain(source: str, keys: list[str], dur: str, steps: list[Step], on_fire: str = "reset", ts: str = "ts", order: str = "event_id", name: str = "w") -> str:
    """CTEs ending in ``name``: the source's columns with window_start, step, fired, value, as ``match.track`` gives them.

    A step's thresholds keep their count n, sum s and list l of seen values side by side.
    """
    k = ", ".join(keys)
    ways = [s.either or (s,) for s in steps]
    most = range(max(map(len, ways)))

    def inputs(i: int, j: int) -> str:
        if j >= len(ways[i]):
            return f"FALSE AS f{i}_{j}, CAST(NULL AS VARCHAR) AS d{i}_{j}, CAST(0 AS DOUBLE) AS v{i}_{j}"
        s = ways[i][j]
        d, v = (f"CAST({s.of} AS VARCHAR)", "CAST(0 AS DOUBLE)") if s.measure == "distinct" else ("CAST(NULL AS VARCHAR)", f"CAST({s.of} AS DOUBLE)")
        return f"coalesce({s.flag}, FALSE) AS f{i}_{j}, {d} AS d{i}_{j}, {v} AS v{i}_{j}"

    flags = ", ".join(inputs(i, j) for i in range(len(steps)) for j in most)
    pick = lambda p, j: "CASE b_at " + " ".join(f"WHEN {i} THEN {p}{i}_{j}" for i in range(len(steps))) + " END"
    measure = {"count": "n1_{j}", "sum": "s1_{j}", "avg": "s1_{j} / n1_{j}", "distinct": "len(l1_{j})"}

    def by_step(j: int, tell) -> str:
        return "CASE b_at " + " ".join(f"WHEN {i} THEN {tell(w[j])}" for i, w in enumerate(ways) if j < len(w)) + " END"

    value = ", ".join(by_step(j, lambda s, j=j: f"CAST({measure[s.measure].format(j=j)} AS DOUBLE)") + f" AS m_{j}" for j in most)
    met = [f"(f_{j} AND m_{j} >= {by_step(j, lambda s: float(s.least))})" for j in most]
    first = "CASE " + " ".join(f"WHEN {met[j]} THEN m_{j}" for j in most) + " END"
    last = len(steps) - 1
    keep = f"(NOT reached{f' OR b_at = {last}' if on_fire == 'every' else ''})"
    fires = f"reached AND b_at = {last}" + (" AND NOT b_done" if on_fire == "once" else "")
    stay = "b_at" if on_fire == "every" else "0"
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM r.{c}" for c in keys)
    each = lambda form: ", ".join(form.replace("#", str(j)) for j in most)
    carried = f"{k}, rn, t1 AS t0, CASE WHEN reached THEN CASE WHEN b_at = {last} THEN {stay} ELSE b_at + 1 END ELSE b_at END AS at"
    return f"""WITH RECURSIVE {name}_r AS (SELECT *, {flags}, row_number() OVER (PARTITION BY {k} ORDER BY {ts}, {order}) AS rn FROM ({source})),
{name}_o AS (SELECT DISTINCT {k}, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS t0, 0 AS at, {each('0 AS n_#, CAST(0 AS DOUBLE) AS s_#, CAST([] AS VARCHAR[]) AS l_#')}, FALSE AS done,
  CAST(NULL AS INTEGER) AS step, FALSE AS fired, CAST(NULL AS DOUBLE) AS value FROM {name}_r
 UNION ALL SELECT {carried}, {each(f'CASE WHEN {keep} THEN n1_# ELSE 0 END, CASE WHEN {keep} THEN s1_# ELSE 0 END, CASE WHEN {keep} THEN l1_# ELSE [] END')},
   b_done OR (reached AND b_at = {last}), CASE WHEN reached THEN b_at END, {fires}, CASE WHEN reached THEN m END
  FROM (SELECT *, coalesce({' OR '.join(met)}, FALSE) AS reached, {first} AS m FROM
   (SELECT *, {value} FROM
    (SELECT *, {each('b_n_# + CASE WHEN f_# THEN 1 ELSE 0 END AS n1_#, b_s_# + CASE WHEN f_# THEN coalesce(v_#, 0) ELSE 0 END AS s1_#, CASE WHEN f_# AND d_# IS NOT NULL AND NOT list_contains(b_l_#, d_#) THEN list_append(b_l_#, d_#) ELSE b_l_# END AS l1_#')},
       CASE WHEN fresh THEN CASE WHEN {' OR '.join(f'f_{j}' for j in most)} THEN t END ELSE t0 END AS t1 FROM
     (SELECT *, {', '.join(f"{pick('f', j)} AS f_{j}, {pick('v', j)} AS v_{j}, {pick('d', j)} AS d_{j}" for j in most)} FROM
      (SELECT {', '.join('r.' + c for c in keys)}, r.rn, r.{ts} AS t, o.t0, {', '.join(f'r.f{i}_{j}, r.v{i}_{j}, r.d{i}_{j}' for i in range(len(steps)) for j in most)},
         (o.t0 IS NULL OR r.{ts} >= o.t0 + INTERVAL {seconds(dur)} SECOND) AS fresh, CASE WHEN fresh THEN 0 ELSE o.at END AS b_at,
         {each('CASE WHEN fresh THEN 0 ELSE o.n_# END AS b_n_#, CASE WHEN fresh THEN 0 ELSE o.s_# END AS b_s_#, CASE WHEN fresh THEN [] ELSE o.l_# END AS b_l_#')}, CASE WHEN fresh THEN FALSE ELSE o.done END AS b_done
       FROM {name}_o o JOIN {name}_r r ON {same} AND r.rn = o.rn + 1)))))),
{name} AS (SELECT r.*, o.t0 AS window_start, o.step, o.fired, o.value AS measure FROM {name}_r r JOIN {name}_o o ON {same} AND r.rn = o.rn)"""
