"""Query 11: Merkle manifest of the documents."""

from pyspark.sql import functions as F

from .catalog import query
from .common import table
from .merkle import manifest

_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g,
    concat_ws('', coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    -- crc32, bit by bit
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 7 = 0 AS changed
  FROM documents),
e AS (
  SELECT doc_id, g, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(length((n_chars + coalesce(changed, false)::INT)::VARCHAR) || ':' || (n_chars + coalesce(changed, false)::INT), '-') || tail) AS claimed
  FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM e),
t AS (
  SELECT g, 0 AS h, list(leaf ORDER BY idx) AS nodes FROM n GROUP BY g
  UNION ALL
  SELECT g, h + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx FROM t WHERE len(nodes) = 1),
u AS (
  SELECT 0 AS h, list(subroot ORDER BY idx) AS nodes FROM s
  UNION ALL
  SELECT h + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM u WHERE len(nodes) > 1),
steps AS (
  SELECT n.doc_id, n.g, n.idx AS place, h, (n.idx >> h) & 1 AS side, nodes[xor(n.idx >> h, 1) + 1] AS sibling FROM n JOIN t ON t.g = n.g AND len(nodes) > 1
  UNION ALL
  SELECT n.doc_id, n.g, n.idx, 100 + h, (s.idx >> h) & 1, nodes[xor(s.idx >> h, 1) + 1] FROM n JOIN s ON s.g = n.g JOIN u ON len(nodes) > 1),
p AS (SELECT g, place, string_agg(sibling, '' ORDER BY h) AS proof, list({'side': side, 'sibling': coalesce(sibling, '')} ORDER BY h) AS path FROM steps GROUP BY g, place),
f AS (
  SELECT n.g, n.idx, 0 AS k, n.claimed AS digest, path FROM n LEFT JOIN p ON p.g = n.g AND p.place = n.idx
  UNION ALL
  SELECT g, idx, k + 1, sha256(CASE WHEN path[k + 1].side = 1 THEN path[k + 1].sibling || digest ELSE digest || path[k + 1].sibling END), path FROM f WHERE k < len(path))
SELECT n.doc_id, n.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.nodes[1] AS verified
FROM n JOIN s ON s.g = n.g LEFT JOIN p ON p.g = n.g AND p.place = n.idx JOIN f ON f.g = n.g AND f.idx = n.idx AND f.k = coalesce(len(f.path), 0)
JOIN u r ON len(r.nodes) = 1
"""


@query("op11_merkle_manifest", _SQL)
def op11_merkle_manifest(spark, folder):
    return manifest(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
