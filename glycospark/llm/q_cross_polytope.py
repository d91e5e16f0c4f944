"""Query 13: near-duplicate embeddings."""

from .catalog import query
from .common import table
from .cross_polytope import near_vectors

_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.c)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, min(r.c) AS component_id, min(r.c) = v.vec_id AS kept
FROM v JOIN r ON r.x = v.vec_id GROUP BY v.vec_id
"""


@query("op13_cross_polytope_classes", _SQL)
def op13_cross_polytope_classes(spark, folder):
    return near_vectors(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")
