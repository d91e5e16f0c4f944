"""Query 8: secret scan of the documents."""

from pyspark.sql import functions as F

from .catalog import query
from .common import table
from .secrets import ACCESS, ASSIGN, BASE, HEX, RULES, scan


def _sql() -> str:
    parts = []
    for place, rule in enumerate(RULES):
        # no (?i) here: it would also fold letters outside ASCII
        pattern = rule.pattern.replace("(?i)", "").replace("'", "''")
        if rule is ASSIGN:
            for word in ("password", "passwd", "secret", "token"):
                pattern = pattern.replace(word, "".join(f"[{c}{c.upper()}]" for c in word))
            pattern = pattern.replace("api_?key", "[aA][pP][iI]_?[kK][eE][yY]")
        parts.append(f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s, len(m[i]) AS n
  FROM (SELECT doc_id, g, m, p, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS p FROM d))
  WHERE len(p[i]) >= {rule.least}""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) FILTER (kind IN ({base})) AS base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) AS spans
  FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


@query("op8_secret_scan", _sql())
def op8_secret_scan(spark, folder):
    found = scan(table(spark, folder, "documents"))
    named = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda rule: F.size(F.filter("spans", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", count(ASSIGN), count(ACCESS), count(HEX), F.sha2(named(base), 256).alias("base_sha256"), named("spans").alias("spans"))
