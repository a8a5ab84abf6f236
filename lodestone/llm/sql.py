"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .annulus import CENTROIDS, COMPONENTS, ROUNDS, SCALE, SEED

#: A SHA-1 in base 32: each five hexadecimal digits are four characters.
_BASE32 = (
    "list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + ((CAST('0x' || substr(sha1(payload), 1 + 5 * i, 5) AS BIGINT) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '')"
)

WARC = f"""
WITH rows AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
numbered AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS n,
  first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS most FROM rows)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN most END AS refers_to FROM numbered
"""


def _rounds() -> str:
    """The rounds one after another, each a table of vectors by cluster and one of centroids."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(
            f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (SELECT v.r, c.k, CAST(list_sum(list_transform(list_zip(v.v, c.c), "
            f"lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM vectors v CROSS JOIN c{i} c) GROUP BY r)"
        )
        if i < ROUNDS:
            out.append(
                f"m{i} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM (SELECT a.best.k AS k, p, sum(v.v[p]) AS s, count(*) AS n "
                f"FROM a{i} a JOIN vectors v ON a.r = v.r CROSS JOIN range(1, {COMPONENTS + 1}) t(p) GROUP BY a.best.k, p) GROUP BY k)"
            )
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)")
    return ",\n".join(out)


CLUSTERS = f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v AS c FROM
  (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vectors ORDER BY h, v LIMIT {CENTROIDS})),
{_rounds()}
SELECT v.vec_id, a.best.k AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN vectors v ON a.r = v.r JOIN c{ROUNDS} c ON a.best.k = c.k
"""

#: CRC-32 of the decimal digits of c, a bit at a time.
_CRC32 = (
    "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda r, x: "
    "list_reduce(list_concat([xor(r, x)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"
)

TRIE = f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT c, c - c % 5 AS base, {_CRC32} % 9 AS h, own FROM (SELECT c, list(said ORDER BY pos) AS own FROM turns GROUP BY c)),
rebuilt AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS path FROM convs a LEFT JOIN convs b ON a.base = b.c),
places AS MATERIALIZED (SELECT c, d, path[1:d] AS prefix, d = len(path) AS ended FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256
  FROM places GROUP BY prefix, d),
parents AS MATERIALIZED (SELECT n.prefix, n.d, count(k.d) AS n_children FROM nodes n LEFT JOIN nodes k ON k.d = n.d + 1 AND k.prefix[1:n.d] = n.prefix GROUP BY n.prefix, n.d),
above AS (SELECT n.prefix[1:x.d] AS prefix, x.d, CASE WHEN p.n_children = 0 THEN 1 ELSE 0 END AS leaf, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.prefix[n.d].t) END AS saved
  FROM nodes n JOIN parents p ON n.d = p.d AND n.prefix = p.prefix CROSS JOIN LATERAL (SELECT unnest(range(0, n.d + 1)) AS d) x),
sums AS (SELECT prefix, d, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY prefix, d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, p.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN parents p ON n.d = p.d AND n.prefix = p.prefix JOIN sums s ON n.d = s.d AND n.prefix = s.prefix LEFT JOIN nodes u ON u.d = n.d - 1 AND u.prefix = n.prefix[1:n.d - 1]
"""
