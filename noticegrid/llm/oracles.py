"""DuckDB texts of the iterative operators, their rounds written out one after the other."""

from __future__ import annotations


def clusters(count: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64) -> str:
    steps = [f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS k, v
    FROM vecs QUALIFY k < {count}
)"""]
    for i in range(rounds):
        steps.append(_assigned(i))
        steps.append(f"""s{i} AS MATERIALIZED (
    SELECT k, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (
        SELECT a.k, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM a{i} AS a JOIN vecs USING (n)
    ) GROUP BY k, p
), c{i + 1} AS MATERIALIZED (
    SELECT c.k, coalesce(m.v, c.v) AS v
    FROM c{i} AS c LEFT JOIN (SELECT k, list(x ORDER BY p) AS v FROM s{i} GROUP BY k) AS m ON c.k = m.k
)""")
    steps.append(_assigned(rounds))
    return f"""
WITH vecs AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension}
), {", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN vecs USING (n) JOIN c{rounds} AS c ON a.k = c.k
"""


def _assigned(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (
    SELECT n, min(d) AS d, arg_min(k, d * 1000 + k) AS k FROM (
        SELECT n, k, CAST(list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM vecs AS w, c{i} AS c
    ) GROUP BY n
)"""


def compressed(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dimension: int = 64) -> str:
    width = dimension // parts
    distance = "CAST(list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [f"""c0 AS MATERIALIZED (
    SELECT p, k, v FROM cut JOIN (
        SELECT n, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM vecs QUALIFY k < {entries}
    ) USING (n)
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT n, p, min(d) AS d, arg_min(k, d * 1000 + k) AS k FROM (
        SELECT w.n, w.p, c.k, {distance} AS d FROM cut AS w JOIN c{i} AS c ON w.p = c.p
    ) GROUP BY n, p
)""")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (
    SELECT p, k, q, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (
        SELECT a.p, a.k, generate_subscripts(v, 1) AS q, unnest(v) AS x FROM a{i} AS a JOIN cut AS w ON a.n = w.n AND a.p = w.p
    ) GROUP BY p, k, q
), c{i + 1} AS MATERIALIZED (
    SELECT c.p, c.k, coalesce(m.v, c.v) AS v
    FROM c{i} AS c LEFT JOIN (SELECT p, k, list(x ORDER BY q) AS v FROM s{i} GROUP BY p, k) AS m ON c.p = m.p AND c.k = m.k
)""")
    return f"""
WITH vecs AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), cut AS MATERIALIZED (
    SELECT n, p, v[p * {width} + 1:(p + 1) * {width}] AS v FROM vecs, range(0, {parts}) AS t(p)
), {", ".join(steps)}, coded AS (
    SELECT n, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n
), digest AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN vecs USING (n), digest
"""


def judged(rounds: int = 30) -> str:
    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), cut AS (
    SELECT row_number() OVER () AS n, page_id, coalesce(html, '') AS html,
           translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), best AS (
    SELECT n, arg_max(r.host || r.path, [length(r.host || r.path), length(r.host), CAST(r.verdict = 'block' AS INTEGER)]) AS rule,
           arg_max(r.verdict, [length(r.host || r.path), length(r.host), CAST(r.verdict = 'block' AS INTEGER)]) AS ruled
    FROM cut, rules AS r
    WHERE (cut.host = r.host OR suffix(cut.host, '.' || r.host)) AND starts_with(cut.path, r.path)
    GROUP BY n
), decided AS MATERIALIZED (
    SELECT cut.n, page_id, host, path, rule, ruled FROM cut LEFT JOIN best ON cut.n = best.n
), pairs AS MATERIALIZED (
    SELECT src, dst, count(*) AS n FROM (
        SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>\\]+)', 1)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
        FROM cut
    ) WHERE src <> dst AND src <> '' GROUP BY src, dst
), links AS MATERIALIZED (
    SELECT src, dst, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS forth, n / CAST(sum(n) OVER (PARTITION BY dst) AS DOUBLE) AS back FROM pairs
), counts AS (
    SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked, count(*) FILTER (ruled IS NULL) AS undecided
    FROM decided WHERE host <> '' GROUP BY host
), hosts AS MATERIALIZED (
    SELECT host, coalesce(allowed, 0) AS allowed, coalesce(blocked, 0) AS blocked, coalesce(undecided, 0) AS undecided,
           host IN (SELECT src FROM pairs) AS leaves, host IN (SELECT dst FROM pairs) AS reached
    FROM counts FULL JOIN (SELECT src AS host FROM pairs UNION SELECT dst FROM pairs) USING (host)
), totals AS MATERIALIZED (
    SELECT greatest(sum(allowed), 1) AS t, greatest(sum(blocked), 1) AS d FROM hosts
), walk AS (
    SELECT 0 AS step, host, CAST(allowed AS DOUBLE) AS trust, CAST(blocked AS DOUBLE) AS distrust FROM hosts
    UNION ALL
    SELECT step + 1, h.host,
           h.allowed * (0.15 + 0.85 * (SELECT coalesce(sum(w.trust), 0) FROM walk AS w JOIN hosts USING (host) WHERE NOT leaves) / totals.t)
             + 0.85 * coalesce((SELECT sum(w.trust * forth) FROM walk AS w JOIN links ON w.host = src WHERE dst = h.host), 0),
           h.blocked * (0.15 + 0.85 * (SELECT coalesce(sum(w.distrust), 0) FROM walk AS w JOIN hosts USING (host) WHERE NOT reached) / totals.d)
             + 0.85 * coalesce((SELECT sum(w.distrust * back) FROM walk AS w JOIN links ON w.host = dst WHERE src = h.host), 0)
    FROM walk JOIN hosts AS h ON walk.host = h.host, totals WHERE step < {rounds}
), shut AS (
    SELECT host FROM walk JOIN hosts USING (host) WHERE step = {rounds} AND distrust > 0.500001 * (distrust + trust + undecided)
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM shut) THEN 'block' ELSE 'allow' END) AS verdict
FROM decided
"""
