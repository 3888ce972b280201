"""A second, neutral set of reference tables whose names occur in the driver's
tables, and the hosts made from those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..reference import Allowed, Brand, Keyword, Reference, Scheme

TLDS = ["com", "net", "sg", "xyz", "com.sg"]

REFERENCE = Reference(
    brands=(
        Brand("widget", "Widget", "shop", ("widget",), 1, False, True, (), ("com", "com.sg")),
        Brand("gizmo", "Gizmo", "shop", ("gizno", "gizmoo"), 1, True, False, ("small", "large"), ("sg",)),
        Brand("ring", "Ring", "metal", ("ring", "rnig"), 0, False, True, (), ()),
        Brand("anvil", "Anvil", "metal", ("anvli", "anvil"), 1, True, False, ("red", "old"), ("net",)),
    ),
    keywords=(
        Keyword("small", "size", True), Keyword("large", "size", True), Keyword("old", "age"), Keyword("new", "age"), Keyword("hot", "heat", True),
        Keyword("red", "color"), Keyword("blue", "color"), Keyword("promo", "price", True), Keyword("economy", "price"),
    ),
    schemes=(
        Scheme("standard", "Standard season", ("standrad", "standard"), 1, "", "1996-01-01", "1997-12-31"),
        Scheme("medium", "Medium", ("medium",), 0),
    ),
    allowlist=(Allowed("standard.sg", "widget"), Allowed("widget.promo", "widget"), Allowed("economy.com.sg", "anvil"), Allowed("large.com", "ring", False)),
)


def part_host() -> Column:
    tld = F.get(F.array(*map(F.lit, TLDS)), F.pmod(F.col("p_size"), F.lit(len(TLDS))))
    return F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), F.lower("p_type"), tld)


def page_host() -> Column:
    return F.regexp_extract("url", "://([^/:?#]+)", 1)


def part_hosts(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("id"), part_host().alias("host"))


PART_SQL = f"SELECT p_partkey AS id, replace(p_name, ' ', '.') || '.' || lower(p_type) || '.' || ({TLDS!r})[p_size % {len(TLDS)} + 1] AS host FROM part"
PAGE_SQL = "SELECT page_id AS id, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def score_sql(hosts: str, as_of: str = "DATE '1996-06-01'") -> str:
    """CTEs h (hosts and their parts), signals (host, family, ord, type, brand,
    scheme, token, points) and scores (host, registrable, suppressed, score,
    severity); ``hosts`` is SQL with a column host."""
    from ..reference import compact

    r, w = REFERENCE, REFERENCE.scoring.weights
    rules = [(x,) for x in r.suffixes if x[0] not in "!*"]
    tokens = [(bi, b.id, ti, t, compact(t), b.distance(compact(t)), b.require_context) for bi, b in enumerate(r.brands) for ti, t in enumerate(b.tokens)]
    context = [(b.id, compact(t)) for b in r.brands for t in b.context_tokens]
    tlds = [(b.id, t) for b in r.brands for t in b.known_tlds]
    lures = [(si, s.id, ti, t, compact(t), s.max_edit_distance, s.start, s.end) for si, s in enumerate(r.schemes) for ti, t in enumerate(s.tokens)]
    near = "EXISTS (SELECT 1 FROM range(1, 64) p(i), (VALUES (-1), (0), (1)) d(w) WHERE {k} >= abs(d.w) AND p.i + length({t}) + d.w - 1 <= length({x}) AND length({t}) + d.w >= 1 AND damerau_levenshtein(substr({x}, p.i, length({t}) + d.w), {t}) <= {k})"
    return f"""
rules(rule) AS (VALUES {_values(rules)}),
raw AS (SELECT DISTINCT host FROM ({hosts})),
suf AS (SELECT host, coalesce((SELECT arg_max(rule, length(rule)) FROM rules WHERE host = rule OR ends_with(host, '.' || rule)), list_last(string_split(host, '.'))) AS suffix FROM raw),
h AS (SELECT host, CASE WHEN length(host) > length(suffix) + 1 THEN list_last(string_split(host[:length(host) - length(suffix) - 1], '.')) || '.' || suffix END AS registrable,
    CASE WHEN length(host) > length(suffix) + 1 THEN suffix ELSE '' END AS suffix, regexp_replace(host, '[^a-z0-9]', '', 'g') AS hc FROM suf),
labels AS (SELECT host, regexp_replace(unnest(string_split(host, '.')), '[^a-z0-9]', '', 'g') AS label FROM h),
subs AS (SELECT host, regexp_replace(unnest(string_split(host[:length(host) - length(registrable) - 1], '.')), '[^a-z0-9]', '', 'g') AS label FROM h WHERE length(host) > length(registrable) + 1),
allowed(registrable, brand) AS (VALUES {_values([(a.registrable, a.brand) for a in r.allowlist if a.verified])}),
tokens(bo, brand, tok_ord, token, tc, k, gated) AS (VALUES {_values(tokens)}),
context(brand, tc) AS (VALUES {_values(context)}),
tlds(brand, tld) AS (VALUES {_values(tlds)}),
keywords(ko, token, tc) AS (VALUES {_values([(i, k.token, compact(k.token)) for i, k in enumerate(r.keywords)])}),
lures(so, scheme, tok_ord, token, tc, k, st, en) AS (VALUES {_values(lures)}),
live AS (SELECT * FROM h WHERE registrable IS NULL OR registrable NOT IN (SELECT registrable FROM allowed)),
hits AS (SELECT live.*, t.bo, t.brand, t.tok_ord, t.token, t.tc, t.k, instr(hc, t.tc) > 0 AS exact_hit
    FROM live, tokens t
    WHERE (NOT t.gated OR EXISTS (SELECT 1 FROM context c WHERE c.brand = t.brand AND instr(live.hc, c.tc) > 0))
    AND (instr(hc, t.tc) > 0 OR EXISTS (SELECT 1 FROM labels l WHERE l.host = live.host AND {near.format(k="t.k", t="t.tc", x="l.label")}))),
first_hits AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY host, brand ORDER BY tok_ord) = 1),
kw AS (SELECT host, ko, token, greatest(0, least({w["kw"]}, {w["keyword_cap"]} - {w["kw"]} * (row_number() OVER (PARTITION BY host ORDER BY ko) - 1))) AS points FROM live, keywords k WHERE instr(hc, k.tc) > 0),
lure_hits AS (SELECT host, so, scheme, token, st, en FROM live, lures t WHERE instr(hc, t.tc) > 0 OR (t.k > 0 AND {near.format(k="t.k", t="t.tc", x="live.hc")})
    QUALIFY row_number() OVER (PARTITION BY host, scheme ORDER BY t.tok_ord) = 1),
signals AS (
    SELECT host, 0 AS family, bo AS ord, CASE WHEN exact_hit THEN 'brand:exact' ELSE 'brand:fuzzy' END AS type, brand, NULL AS scheme, token, CASE WHEN exact_hit THEN {w["brand:exact"]} ELSE {w["brand:fuzzy"]} END AS points FROM first_hits
    UNION ALL SELECT host, 0, bo, 'subdomain_brand_squat', brand, NULL, token, {w["subdomain:brand_squat"]} FROM first_hits f WHERE EXISTS (SELECT 1 FROM subs l WHERE l.host = f.host AND {near.format(k="f.k", t="f.tc", x="l.label")})
    UNION ALL SELECT host, 0, bo, 'brand_in_path_position', brand, NULL, token, {w["brand_in_path_position"]} FROM first_hits f WHERE EXISTS (SELECT 1 FROM allowed a WHERE a.brand = f.brand AND (starts_with(f.host, a.registrable || '.') OR instr(f.host, '.' || a.registrable || '.') > 0))
    UNION ALL SELECT host, 0, bo, 'tld:mismatch', brand, NULL, NULL, {w["tld:mismatch"]} FROM first_hits f WHERE EXISTS (SELECT 1 FROM tlds t WHERE t.brand = f.brand) AND NOT EXISTS (SELECT 1 FROM tlds t WHERE t.brand = f.brand AND t.tld = f.suffix)
    UNION ALL SELECT host, 1, ko, 'kw', NULL, NULL, token, points FROM kw WHERE points > 0
    UNION ALL SELECT host, 2, so, 'scheme', NULL, scheme, token, {w["scheme"]} FROM lure_hits
    UNION ALL SELECT host, 2, so, 'scheme_seasonal_boost', NULL, scheme, token, {w["scheme_seasonal_boost"]} FROM lure_hits WHERE {as_of} BETWEEN st::DATE AND en::DATE
), sums AS (
    SELECT host, sum(points) AS points, coalesce(bool_or(starts_with(type, 'brand:')), false) AS has_brand, coalesce(bool_or(type = 'kw'), false) AS has_kw, coalesce(bool_or(type = 'scheme'), false) AS has_scheme, count(*) AS n FROM signals GROUP BY host
), scored AS (
    SELECT h.host, h.registrable, h.host NOT IN (SELECT host FROM live) AS suppressed,
        CASE WHEN h.host NOT IN (SELECT host FROM live) THEN 0 ELSE least({r.scoring.cap}, coalesce(points, 0) + CASE WHEN has_brand AND has_kw THEN {w["combo_brand_keyword"]} WHEN has_scheme AND has_kw THEN {w["combo_scheme_keyword"]} ELSE 0 END) END::INT AS score,
        CASE WHEN h.host NOT IN (SELECT host FROM live) THEN 1 ELSE coalesce(n, 0) + CASE WHEN has_kw AND (has_brand OR has_scheme) THEN 1 ELSE 0 END END AS n_signals
    FROM h LEFT JOIN sums USING (host)
), scores AS (SELECT *, CASE WHEN score >= {r.scoring.critical} THEN 'critical' WHEN score >= {r.scoring.high} THEN 'high' WHEN score >= {r.scoring.medium} THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS severity FROM scored)
"""
