"""Query 5: verdicts on the urls of the pages."""

from .catalog import query
from .common import table
from .url_filter import SECOND, STRONG, URL, WEAK, WIDTH, judge

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _level(name: str, keys: str, groups: str) -> str:
    """CTEs that shrink ``groups`` (keys, good, seen, parent) as the operator does."""
    exact = lambda x: f"CAST(sum(CAST(round({x}, 9) AS DECIMAL(28, 9))) AS DOUBLE)"
    share = f"least(greatest(coalesce(a / nullif(b, 0), 0), {1 / (STRONG + 1)!r}), {1 / (WEAK + 1)!r})"
    return f"""
{name}_g AS ({groups}),
{name}_s AS (
  SELECT {exact('pow(good / seen - parent, 2) - parent * (1 - parent) / seen')} AS a, {exact('parent * (1 - parent) * (1 - 1 / seen)')} AS b
  FROM (SELECT CAST(good AS DOUBLE) AS good, CAST(seen AS DOUBLE) AS seen, parent FROM {name}_g WHERE seen > 0)),
{name} AS (SELECT {keys}, seen, m AS weight, (good + m * parent) / (seen + m) AS mean FROM {name}_g, (SELECT 1 / {share} - 1 AS m FROM {name}_s))"""


_RULES = ", ".join(f"('{p}', '{v}', '{p.partition('/')[0]}', '/{p.partition('/')[2]}')" for p, v in RULES)
_TWO = f"len(l) >= 3 AND l[-2] IN ({', '.join(repr(s) for s in SECOND)}) AND len(l[-1]) = 2"
_BARE = "len(l) < 2 OR regexp_matches(name, '^[0-9.]+$')"

SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULES}) t(rule, verdict, rh, rp)),
f AS (
  SELECT rid, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
q AS (SELECT p.*, rule, verdict FROM p LEFT JOIN f USING (rid)),
h0 AS (
  SELECT host, count(verdict) AS seen, count(*) FILTER (verdict = 'allow') AS good,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, string_split(name, '.') AS l FROM q GROUP BY host),
h AS (
  SELECT host, seen, good,
    CASE WHEN {_BARE} THEN name WHEN {_TWO} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
    CASE WHEN {_BARE} THEN name WHEN {_TWO} THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(seen) AS seen, sum(good) AS good FROM h GROUP BY domain, suffix),
{_level("sx", "suffix", "SELECT suffix, sum(good) AS good, sum(seen) AS seen, (SELECT (sum(good) + 1) / (sum(seen) + 2) FROM d) AS parent FROM d GROUP BY suffix")},
{_level("dx", "domain, suffix", "SELECT d.domain, d.suffix, d.good, d.seen, sx.mean AS parent FROM d JOIN sx USING (suffix)")},
{_level("hx", "host", "SELECT h.host, h.good, h.seen, dx.mean AS parent FROM h JOIN dx USING (domain, suffix)")},
b AS (SELECT host, round(mean, 6) AS reputation, round(mean + {WIDTH} * sqrt(mean * (1 - mean) / (seen + weight + 1)), 6) AS bound FROM hx)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, reputation, bound
FROM q LEFT JOIN b USING (host)
"""


@query("op5_url_filter", SQL)
def op5_url_filter(spark, folder):
    return judge(table(spark, folder, "pages"), RULES)
