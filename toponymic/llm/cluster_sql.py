"""DuckDB SQL of the centroid clustering: the same rounds, one common table each."""

from __future__ import annotations


def clustering_sql(size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, prefix: str = "3:") -> str:
    """Rows of the registered query over ``embeddings``, without any bound: every vector meets every centroid."""
    parts = [f"""
kept AS (SELECT vec_id, embedding FROM embeddings
         WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
vec AS MATERIALIZED (SELECT vec_id, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
                     FROM kept, range(1, {size + 1}) AS r(i)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{prefix}' || vec_id)) - 1 AS c FROM kept
          ORDER BY sha256('{prefix}' || vec_id) LIMIT {k}),
cent0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN vec USING (vec_id))"""]
    for t in range(rounds + 1):
        parts.append(f"""
dist{t} AS (SELECT v.vec_id, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d
            FROM vec v JOIN cent{t} m USING (i) GROUP BY v.vec_id, m.c),
near{t} AS MATERIALIZED (SELECT vec_id, min(d) AS d, CAST(arg_min(c, (d, c)) AS INTEGER) AS c FROM dist{t} GROUP BY vec_id)""")
        if t < rounds:
            parts.append(f"""
sum{t} AS (SELECT n.c, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM vec v JOIN near{t} n USING (vec_id) GROUP BY n.c, v.i),
cent{t + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, m.x) AS x
             FROM cent{t} m LEFT JOIN sum{t} s ON s.c = m.c AND s.i = m.i)""")
    parts.append(f"""
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM cent{rounds} GROUP BY c),
total AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM near{rounds} GROUP BY c)""")
    return ("WITH " + ",".join(parts) + f"""
SELECT n.vec_id, n.c AS cluster, n.d AS distance, t.s AS cluster_inertia,
       (SELECT CAST(sum(d) AS BIGINT) FROM near{rounds}) AS inertia, g.h AS centroid_sha256
FROM near{rounds} n JOIN total t ON t.c = n.c JOIN digest g ON g.c = n.c""")
