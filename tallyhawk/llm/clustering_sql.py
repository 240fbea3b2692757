"""DuckDB form of ``clustering.clustered``: one pair of tables a round, all in whole numbers."""

from __future__ import annotations

_DISTANCE = "list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"


def clusters(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    def nearest(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT row_id, min(struct_pack(d := d, n := n)) AS best FROM (
  SELECT v.row_id, c.n, CAST({_DISTANCE.format(dim=dim)} AS BIGINT) AS d FROM vectors v CROSS JOIN c{r} c) GROUP BY row_id)"""

    def moved(r: int) -> str:
        sums = f"""SELECT n, list(m ORDER BY i) AS x FROM (
  SELECT best.n AS n, i, CAST((sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM a{r} JOIN vectors v USING (row_id) CROSS JOIN range(1, {dim} + 1) t(i) GROUP BY 1, 2) GROUP BY n"""
        return f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN ({sums}) s ON s.n = c.n)"

    steps = [
        f"""vectors AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS n, x FROM vectors ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        steps += [nearest(r), moved(r)]
    steps.append(nearest(rounds))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.n AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.n) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (row_id) JOIN c{rounds} c ON c.n = best.n"""
