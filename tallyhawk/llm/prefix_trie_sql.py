"""DuckDB form of ``prefix_trie.trie`` over conversations with shared starts: nodes are keyed by the hashes of their turns, one after the other."""

#: CRC-32 by its table of 256 entries, over the decimal digits of an id.
_CRC_TABLE = "SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entries FROM range(256) r(i)"
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])))"


def trie(every: int, modulus: int) -> str:
    return f"""
WITH crc AS ({_CRC_TABLE}),
own AS (SELECT conv_id, list(struct_pack(k := md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), chars := length(coalesce(text, ''))) ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT conv_id, conv_id - conv_id % {every} AS base, {_CRC} % {modulus} AS h, t FROM own, crc),
rebuilt AS (SELECT s.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, s.h), list_slice(s.t, s.h + 1, len(s.t))) AS t FROM sized s LEFT JOIN own b ON b.conv_id = s.base),
prefixes AS (SELECT conv_id, d, len(t) = d AS ends, array_to_string(list_transform(list_slice(t, 1, d), lambda x: x.k), '') AS key, CASE WHEN d > 0 THEN t[d].chars ELSE 0 END AS chars
  FROM rebuilt, range(0, (SELECT coalesce(max(len(t)), 0) + 1 FROM rebuilt)) r(d) WHERE d <= len(t)),
nodes AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(chars) AS own_saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, d),
children AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN children USING (key)),
below AS (SELECT left(key, CAST(32 * a AS BIGINT)) AS key, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(own_saved) AS saved
  FROM counted, range(0, (SELECT coalesce(max(d), 0) + 1 FROM nodes)) r(a) WHERE a <= d GROUP BY 1)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n AS n_convs, CAST(c.kids AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (key) LEFT JOIN nodes p ON c.d > 0 AND p.key = left(c.key, 32 * (c.d - 1))
"""
