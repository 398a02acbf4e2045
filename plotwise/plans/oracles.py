"""DuckDB SQL of the registered queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from ..functions.geo import EARTH_MILES, OCTANTS
from ..operators.features import FEATURES, LOGGED, SCORE_WEIGHTS
from ..operators.layers import RANK_COLORS
from ..operators.similarity import WEIGHTS
from ..operators.spatial import ANCHORS
from .universe import AREAS

U = AREAS.format(customer="customer", nation="nation", region="region", orders="orders")
Z = [f"{c}_z" for c in FEATURES]


def r(columns, sql: str, digits: int = 6) -> str:
    """``sql`` with these columns rounded, as the queries round theirs."""
    columns = columns.split() if isinstance(columns, str) else columns
    return f"SELECT * REPLACE ({', '.join(f'ROUND({c}, {digits}) + 0.0 AS {c}' for c in columns)}) FROM ({sql})"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * {EARTH_MILES} * asin(sqrt(least({h}, 1.0))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))"
    return f"fmod(fmod(degrees(atan2({y}, {x})) + 360.0, 360.0) + 360.0, 360.0)"


def octant(d: str) -> str:
    return f"CASE {' '.join(f'WHEN {d} > {45 * k - 22.5} AND {d} <= {45 * k + 22.5} THEN {OCTANTS[k]!r}' for k in range(1, 8))} ELSE 'N' END"


def median_of(c: str, t: str) -> str:
    return f"coalesce((SELECT quantile_cont({c}, 0.5) FROM {t}), 0.0)"


def imputed(t: str, columns) -> str:
    return f"SELECT * REPLACE ({', '.join(f'coalesce({c}, {median_of(c, t)}) AS {c}' for c in columns)}) FROM {t}"


def logged(t: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'ln(1 + greatest({c}, CASE WHEN {c} IS NULL THEN NULL ELSE 0.0 END)) AS {c}' for c in LOGGED)}) FROM {t}"


def clipped(t: str, columns, p: float) -> str:
    q = lambda c, x: f"(SELECT quantile_cont({c}, {x}) FROM {t})"
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {q(c, p)}), {q(c, 1 - p)}) END AS {c}' for c in columns)}) FROM {t}"


def scaled(t: str, columns=FEATURES) -> str:
    """All of ``t`` and the robust z of ``columns``."""
    filled = f"(SELECT {', '.join(f'coalesce({c}, {median_of(c, t)}) AS {c}' for c in columns)} FROM {t})"
    q = lambda c, x: f"(SELECT quantile_cont({c}, {x}) FROM {filled})"
    z = [f"(coalesce({c}, {median_of(c, t)}) - {q(c, 0.5)}) / (CASE WHEN {q(c, 0.75)} - {q(c, 0.25)} = 0 THEN 1.0 ELSE {q(c, 0.75)} - {q(c, 0.25)} END) AS {c}_z" for c in columns]
    return f"SELECT *, {', '.join(z)} FROM {t}"


def with_(*tables: tuple[str, str], last: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(f'{name} AS ({sql})' for name, sql in tables)} {last}"


u, uz = ("u", U), ("uz", scaled("u"))
SCORE = " + ".join(f"{w} * coalesce({c}_z, 0.0)" for c, w in SCORE_WEIGHTS.items())
score = ("s", f"SELECT *, 0.0 + {SCORE} AS location_score FROM uz")
anchors = ("an", "VALUES " + ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(ANCHORS)))
anchors = ("an", f"SELECT col0 AS anchor_idx, col1 AS anchor_lat, col2 AS anchor_lon FROM ({anchors[1]})")
snapped = ("sn", "SELECT anchor_idx, arg_min(area_id, {'d': pow(lat - anchor_lat, 2) + pow(lon - anchor_lon, 2), 'r': row_ord}) AS area_id FROM u, an WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY anchor_idx")
distinct = ("a0", "SELECT DISTINCT area_id FROM sn")


def edges(miles: float, name: str = "e") -> tuple[str, str]:
    return name, f"SELECT * FROM (SELECT a.area_id AS src, b.area_id AS dst, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist_mi FROM u a JOIN u b ON a.area_id <> b.area_id AND abs(a.lat - b.lat) <= {miles / 69.0}) WHERE dist_mi <= {miles}"


steps = ("st", """SELECT CAST(i AS INTEGER) AS scenario_idx, i / 100.0::DOUBLE AS t, CAST(0.01 AS DOUBLE) + CAST(0.10 - 0.01 AS DOUBLE) * (i / 100.0::DOUBLE) AS fdr_alpha, CAST(0.7 AS DOUBLE) + (CAST(0.4 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * (i / 100.0::DOUBLE) AS min_pass_rate,
  CAST(2.0 AS DOUBLE) + (CAST(0.8 AS DOUBLE) - CAST(2.0 AS DOUBLE)) * (i / 100.0::DOUBLE) AS store_buffer_mi, greatest(CAST(1.0 AS DOUBLE) - CAST(0.5 AS DOUBLE) * (i / 100.0::DOUBLE), 0.01) AS ring_fallback_mi,
  CAST(round_even(20.0::DOUBLE - 10.0::DOUBLE * (i / 100.0::DOUBLE), 0) AS INTEGER) AS min_select, round_even(4000.0::DOUBLE + 6000.0::DOUBLE / (1.0::DOUBLE + 3.0::DOUBLE * (i / 100.0::DOUBLE)), 0) AS demand, 1.5::DOUBLE + sqrt(i / 100.0::DOUBLE) AS max_search_mi FROM range(100) x(i)""")
cumulative = ("cw", "SELECT e.src, e.dist_mi, sum(coalesce(u.potential_bus, 0.0)) OVER (PARTITION BY e.src ORDER BY e.dist_mi, e.dst ROWS UNBOUNDED PRECEDING) AS w FROM e JOIN u ON u.area_id = e.dst")
rings = ("rg", "SELECT src, scenario_idx, min(dist_mi) AS ring_mi FROM cw, st WHERE w >= demand AND dist_mi <= max_search_mi GROUP BY src, scenario_idx")
passed = ("cd", f"""SELECT st.*, u.*, rg.ring_mi, CASE WHEN ring_mi > 0 THEN ring_mi ELSE ring_fallback_mi END AS ring_used_mi FROM u JOIN rg ON rg.src = u.area_id JOIN st USING (scenario_idx)
  WHERE u.area_id NOT IN (SELECT area_id FROM a0) AND coalesce(p_fdr, CASE WHEN (SELECT count(p_fdr) FROM u) = 0 THEN 0.0 ELSE 1.0 END) <= fdr_alpha AND pass_rate >= min_pass_rate AND select_count >= min_select AND ring_mi <= max_search_mi
  AND NOT EXISTS (SELECT 1 FROM u x WHERE x.area_id IN (SELECT area_id FROM a0) AND {hav('u.lat', 'u.lon', 'x.lat', 'x.lon')} < greatest(CASE WHEN ring_mi > 0 THEN ring_mi ELSE ring_fallback_mi END, store_buffer_mi))""")
found = [u, anchors, snapped, distinct, edges(2.5), steps, cumulative, rings, passed]
queue = ("q", "SELECT *, row_number() OVER (PARTITION BY scenario_idx ORDER BY pass_rate DESC, select_count DESC, row_ord, area_id) AS n FROM cd")
greedy = ("g", f"""SELECT scenario_idx, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id VARCHAR, lat DOUBLE, lon DOUBLE, r DOUBLE)[]) AS kept FROM (SELECT DISTINCT scenario_idx FROM q)
  UNION ALL SELECT g.scenario_idx, q.n, CASE WHEN len(g.kept) >= 15 OR len([1 FOR k IN g.kept IF {hav('k.lat', 'k.lon', 'q.lat', 'q.lon')} < greatest(k.r, q.ring_used_mi)]) > 0 THEN g.kept
  ELSE list_append(g.kept, {{'id': q.area_id, 'lat': q.lat, 'lon': q.lon, 'r': q.ring_used_mi}}) END FROM g JOIN q ON q.scenario_idx = g.scenario_idx AND q.n = g.n + 1""")
chosen = ("kp", "SELECT q.*, k.kept_rank FROM (SELECT scenario_idx, unnest(kept).id AS area_id, CAST(unnest(range(1, len(kept) + 1)) AS INTEGER) AS kept_rank FROM (SELECT scenario_idx, arg_max(kept, n) AS kept FROM g GROUP BY scenario_idx)) k JOIN q USING (scenario_idx, area_id)")
kept = [*found, queue, greedy, chosen]
by_area = ("ba", """SELECT *, ladder_count / 100.0::DOUBLE AS ladder_freq, ladder_count / 100.0::DOUBLE * (1.0 - t_first) AS robustness FROM (SELECT area_id, count(*) AS ladder_count, min(t) AS t_first, max(t) AS t_last, quantile_cont(ring_used_mi, 0.5) AS ring_med,
  quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon, min(borough) AS borough, quantile_cont(pass_rate, 0.5) AS pass_rate_med, sum(potential_bus) AS pbus_sum, max(pass_rate) AS pass_rate FROM kp GROUP BY area_id)""")


def stable(v: str) -> str:
    tau = f"(list_sum({v}) / 6)"
    return f"[0.85 * x + 0.15 * {tau} + 0.001 * {tau} FOR x IN {v}]"


def variances(cond: str) -> str:
    return "[" + ", ".join(f"greatest(coalesce(var_samp({c}), 0.0), 1e-12) + 1e-9" for c in Z) + "]" + cond


models = [
    ("gm", f"SELECT {stable('v')} AS g FROM (SELECT {variances('')} AS v FROM uz)"),
    ("bm", f"SELECT borough, {stable('v')} AS b FROM (SELECT borough, {variances('')} AS v FROM uz GROUP BY borough HAVING count(*) >= 50)"),
    ("mm", f"SELECT borough, {stable('m')} AS variances FROM (SELECT borough, [0.9 * b[i] + 0.1 * g[i] + 1e-9 FOR i IN range(1, 7)] AS m FROM bm, gm) UNION ALL SELECT NULL, g FROM gm"),
]
points = ("p", f"SELECT area_id, borough, lat, lon, [{', '.join(Z)}] AS z FROM uz")
d2 = "list_sum([(a.z[i] - p.z[i]) * (a.z[i] - p.z[i]) / a.variances[i] FOR i IN range(1, 7)])"
anchored = ("a", "SELECT p.area_id AS anchor, p.borough, p.lat, p.lon, p.z, coalesce(m.variances, (SELECT variances FROM mm WHERE borough IS NULL)) AS variances FROM p JOIN a0 USING (area_id) LEFT JOIN mm m ON m.borough = p.borough")
base = [u, uz, anchors, snapped, distinct, *models, points, anchored, edges(1.0)]
near = ("nd", f"SELECT a.anchor, p.area_id, {d2} AS d2 FROM a JOIN e ON e.src = a.anchor JOIN p ON p.area_id = e.dst")
close = ("nd", f"{near[1]} WHERE {hav('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 1.2")
limits = ("th", f"""SELECT a.anchor, coalesce(threshold, 0.0) AS threshold, coalesce(n_values, 0) AS n_values FROM a LEFT JOIN (SELECT anchor, quantile_cont(d2, 0.95) AS threshold, count(*) AS n_values FROM (SELECT anchor, d2 FROM nd UNION ALL
  SELECT a.anchor, {d2} FROM a JOIN p ON p.borough = a.borough AND p.area_id <> a.anchor WHERE (SELECT count(*) FROM nd WHERE nd.anchor = a.anchor) < 8) GROUP BY anchor) USING (anchor)""")
members = ("mb", f"SELECT a.anchor, p.area_id FROM a JOIN p ON p.area_id = a.anchor OR {hav('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 1.2")
cov_pairs = [(i, j) for i in range(6) for j in range(6)]
inner = ("ie", "SELECT m.anchor, count(*) AS edges FROM mb m JOIN e ON e.src = m.area_id JOIN mb o ON o.anchor = m.anchor AND o.area_id = e.dst GROUP BY m.anchor")
member_rows = ("pr", f"""SELECT m.anchor, any_value(a.borough) AS borough, count(*) AS cluster_size, [{', '.join(f'avg(p.z[{i + 1}])' for i in range(6))}] AS mu,
  CASE WHEN count(*) > 1 THEN [{', '.join(f'covar_samp(p.z[{i + 1}], p.z[{j + 1}])' for i, j in cov_pairs)}] ELSE [{', '.join('1.0' if i == j else '0.0' for i, j in cov_pairs)}] END AS cov, any_value(a.z) AS az,
  max({hav('a.lat', 'a.lon', 'p.lat', 'p.lon')}) AS max_radius_mi, avg({hav('a.lat', 'a.lon', 'p.lat', 'p.lon')}) AS mean_radius_mi FROM mb m JOIN p ON p.area_id = m.area_id JOIN a ON a.anchor = m.anchor GROUP BY m.anchor""")
profile = ("pf", "SELECT pr.*, cluster_size - 1 AS n_twins, sqrt(list_sum([(az[i] - mu[i]) * (az[i] - mu[i]) FOR i IN range(1, 7)])) AS anch_gap, CASE WHEN cluster_size > 1 THEN coalesce(edges, 0) / (cluster_size * (cluster_size - 1))::DOUBLE ELSE 0.0 END AS adj_density FROM pr LEFT JOIN ie USING (anchor)")
profiles = [*base, members, inner, member_rows, profile]


def l2(a: str, b: str, n: int) -> str:
    return f"sqrt(list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) FOR i IN range(1, {n + 1})]))"


scale = lambda s: f"[ln(1 + {s}.cluster_size), ln(1 + {s}.max_radius_mi), ln(1 + {s}.mean_radius_mi)]"
pairs = [
    ("d0", f"SELECT a.anchor AS a_anchor, b.anchor AS b_anchor, a.borough AS ab, b.borough AS bb, {l2('a.mu', 'b.mu', 6)} AS dist_comp, {l2('a.cov', 'b.cov', 36)} AS dist_disp, {l2(scale('a'), scale('b'), 3)} AS dist_scale, abs(a.adj_density - b.adj_density) AS dist_shape, abs(a.anch_gap - b.anch_gap) AS dist_anchor FROM pf a, pf b"),
    ("d1", f"SELECT *, {' + '.join(f'{w} * dist_{k} / greatest((SELECT quantile_cont(dist_{k}, 0.9) FROM d0), 1e-9)' for k, w in WEIGHTS.items())} + CASE WHEN ab = bb THEN 0.0 ELSE 0.02 END AS composite_dist FROM d0"),
    ("d2", "SELECT *, least(greatest(100.0 * (1 - composite_dist / greatest((SELECT quantile_cont(composite_dist, 0.9) FROM d1), 1e-9)), 0.0), 100.0) AS similarity_pct FROM d1"),
]
vec = [
    ("v", "SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL"),
    ("l", "SELECT vec_id, label, i, e[i] AS x FROM v, range(1, 65) t(i)"),
    ("c", "SELECT label, list(m ORDER BY i) AS c, max(n) AS n FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM l GROUP BY label, i) GROUP BY label"),
    ("cm", "SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM l GROUP BY i)"),
]
sq = lambda a, b: f"list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) FOR i IN range(1, 65)])"
validity = [
    *vec,
    ("dd", f"SELECT a.vec_id, a.label AS own, b.label AS other, sum(sqrt({sq('a.e', 'b.e')})) AS t, count(*) AS n FROM v a, v b GROUP BY a.vec_id, a.label, b.label"),
    ("sl", "SELECT avg(CASE WHEN nn = 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n FROM (SELECT vec_id, max(CASE WHEN own = other THEN t / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = other THEN n END) AS nn, min(CASE WHEN own <> other THEN t / n END) AS b FROM dd GROUP BY vec_id)"),
    ("dp", f"SELECT v.label, count(*) AS n, avg(sqrt({sq('v.e', 'c.c')})) AS spread, sum({sq('v.e', 'c.c')}) AS within, any_value(c.c) AS c FROM v JOIN c ON c.label = v.label GROUP BY v.label"),
    ("ch", f"SELECT sum(n * {sq('dp.c', 'cm.c')}) / sum(within) * (sum(n) - count(*)) / (count(*) - 1) AS calinski_harabasz FROM dp, cm"),
    ("db", f"SELECT avg(w) AS davies_bouldin FROM (SELECT a.label, max((a.spread + b.spread) / sqrt({sq('a.c', 'b.c')})) AS w FROM dp a JOIN dp b ON a.label <> b.label GROUP BY a.label)"),
    ("cs", "SELECT min(n) AS smallest, max(n) AS largest, count(*) FILTER (n < 45) AS small_clusters, count(*) FILTER (n < 45) / 12.0::DOUBLE AS small_fraction, stddev_pop(n) / avg(n) AS imbalance_std, (max(n) - min(n)) / max(n)::DOUBLE AS imbalance_range FROM (SELECT k, (SELECT count(*) FROM v WHERE label = k) AS n FROM range(12) t(k))"),
]


def share_pair(land: str, water: str) -> str:
    part = lambda a, b: f"least(greatest(coalesce(coalesce({a}, 0) / nullif(coalesce({a}, 0) + coalesce({b}, 0), 0), 0.0), 0.0), 1.0)"
    return f"{part(land, water)} AS land_share, {part(water, land)} AS water_share"


ids = """SELECT CAST(n AS INTEGER) AS n, normalized, canonical, plain, CASE substr(normalized, 3, 3) WHEN '005' THEN 'Bronx' WHEN '047' THEN 'Brooklyn' WHEN '061' THEN 'Manhattan' WHEN '081' THEN 'Queens' WHEN '085' THEN 'Staten Island' ELSE 'Unknown' END AS borough, substr(normalized, 1, 12) AS area FROM (
  SELECT n, replace(raw, '1500000US', '') AS plain, CASE WHEN digits = '' THEN '' ELSE right(lpad(digits, CAST(greatest(12, length(digits)) AS INTEGER), '0'), 12) END AS canonical, CASE WHEN regexp_full_match(s, '[0-9]{1,11}') THEN lpad(s, 12, '0') ELSE s END AS normalized FROM (
    SELECT n, raw, regexp_replace(bare, '[^0-9]', '', 'g') AS digits, CASE WHEN regexp_matches(cut, '[eE]') THEN coalesce(CAST(TRY_CAST(TRY_CAST(cut AS DOUBLE) AS DECIMAL(38, 0)) AS VARCHAR), cut) ELSE cut END AS s FROM (
      SELECT *, regexp_replace(bare, '[.]0$', '') AS cut FROM (SELECT n, coalesce(raw, '') AS raw, replace(trim(coalesce(raw, '')), '1500000US', '') AS bare FROM (VALUES (0, NULL), (1, ''), (2, '1500000US360050001001'), (3, '360050001001.0'),
        (4, '3.60050001001E11'), (5, '60050001001'), (6, ' 360050001001 '), (7, '3600500010011'), (8, '36-047-000100.1'), (9, 'nodigits'), (10, '360610001001'), (11, '360810001001'), (12, '360850001001')) t(n, raw)))))"""
reasons = "CAST(flag AS INTEGER) AS excluded_by_flag, CAST(open AS INTEGER) AS excluded_open_space, CAST(wet AS INTEGER) AS excluded_water_dominated, CAST(nof AS INTEGER) AS excluded_missing_features, CAST(nog AS INTEGER) AS excluded_missing_geometry"
ledger = f"""WITH u AS ({U}), us AS (SELECT *, {share_pair('aland', 'awater')} FROM u), g AS (SELECT area_id, open_space_share, land_share FROM us WHERE aland > 20), f AS (SELECT area_id, exclusion FROM us WHERE median_income > -900),
j AS (SELECT coalesce(g.area_id, f.area_id) AS area_id, CASE WHEN f.area_id IS NULL THEN 'no' ELSE f.exclusion END AS exclusion, open_space_share, land_share, f.area_id IS NULL AS nof, g.area_id IS NULL AS nog FROM g FULL JOIN f ON f.area_id = g.area_id),
k AS (SELECT *, lower(trim(coalesce(exclusion, 'nan'))) <> 'no' AS flag, coalesce(open_space_share, 0.0) >= 0.6 AS open, coalesce(land_share, 1.0) < 0.1 AS wet FROM j)
SELECT area_id, exclusion, open_space_share, land_share, {reasons} FROM k WHERE flag OR open OR wet OR nof OR nog"""

ORACLES = {
    "normalize_ids": ids,
    "exclusion_ledger": r("open_space_share land_share", ledger),
    "land_water_shares": r("land_area water_area land_share water_share", f"SELECT area_id, land_area, water_area, {share_pair('land_area', 'water_area')} FROM (SELECT l_partkey AS area_id, sum(l_quantity) AS land_area, sum(round(l_discount * 100, 0)) AS water_area FROM lineitem GROUP BY l_partkey)"),
    "share_cascade": r("land_share water_share", f"WITH u AS ({U}), b AS (SELECT area_id, {share_pair('l', 'w')} FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS area_id, sum(l_quantity) AS l, sum(CAST(l_linenumber AS DOUBLE)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)), o AS (SELECT area_id, {share_pair('aland', 'awater')} FROM u) SELECT o.area_id, coalesce(b.land_share, o.land_share) AS land_share, coalesce(b.water_share, o.water_share) AS water_share FROM o LEFT JOIN b USING (area_id)"),
    "numeric_clean": r("value", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 12.5::DOUBLE ELSE c_acctbal END AS value, CAST(NULL AS DOUBLE) AS none FROM customer"),
    "median_impute": r("share_college_plus pop_density p_fdr", with_(u, ("i", imputed("u", ["share_college_plus", "pop_density", "p_fdr"])), last="SELECT area_id, share_college_plus, pop_density, p_fdr FROM i")),
    "winsorize": r(FEATURES, with_(u, ("w", clipped("u", FEATURES, 0.05)), last=f"SELECT area_id, {', '.join(FEATURES)} FROM w")),
    "log1p_features": r(LOGGED, with_(u, ("l", logged("u")), last=f"SELECT area_id, {', '.join(LOGGED)} FROM l")),
    "robust_z": r(Z, with_(u, uz, last=f"SELECT area_id, {', '.join(Z)} FROM uz")),
    "prep_cluster_matrix": r(Z, with_(u, ("i", imputed("u", FEATURES)), ("l", logged("i")), ("w", clipped("l", FEATURES, 0.01)), ("z", scaled("w")), last=f"SELECT area_id, {', '.join(Z)} FROM z")),
    "prep_optimal_matrix": r(Z, with_(u, ("l", logged("u")), ("w", clipped("l", LOGGED, 0.01)), ("i", imputed("w", FEATURES)), ("z", scaled("i")), last=f"SELECT area_id, {', '.join(Z)} FROM z")),
    "location_score": r("location_score", with_(u, uz, score, last="SELECT area_id, location_score FROM s")),
    "rank_groups": r("mean_score", with_(u, uz, score, last="SELECT borough, mean_score, CAST(row_number() OVER (ORDER BY mean_score DESC, borough) AS INTEGER) AS group_rank FROM (SELECT borough, avg(location_score) AS mean_score FROM s GROUP BY borough)")),
    "cluster_profiles": r([f"{c}_{k}" for c in FEATURES for k in ("mean", "median")], with_(u, last=f"SELECT borough, {', '.join(f'avg({c}) AS {c}_mean, quantile_cont({c}, 0.5) AS {c}_median, count({c}) AS {c}_count' for c in FEATURES)} FROM u GROUP BY borough")),
    "twin_features": r("share_college_plus share_commute_60p pop_density occ_units_density comp_per_km2 potbus_per_1k", f"""WITH u AS ({U}), k AS (SELECT area_id, aland / 1e6 AS km, potential_bus, row_ord * 7 % 90 AS et, row_ord * 3 % 11 + row_ord * 5 % 7 + row_ord * 2 % 5 + row_ord % 3 AS ec, row_ord * 11 % 60 AS ct, row_ord * 13 % 17 AS c6, row_ord * 19 % 1500 AS pop, row_ord * 23 % 700 AS occ, row_ord * 29 % 9 AS comp FROM u)
SELECT area_id, coalesce(ec / nullif(et, 0)::DOUBLE, 0) AS share_college_plus, coalesce(c6 / nullif(ct, 0)::DOUBLE, 0) AS share_commute_60p, ln(1 + coalesce(pop / nullif(km, 0), 0)) AS pop_density, ln(1 + coalesce(occ / nullif(km, 0), 0)) AS occ_units_density, ln(1 + coalesce(comp / nullif(km, 0), 0)) AS comp_per_km2, ln(1 + coalesce(1000.0 * potential_bus / nullif(pop, 0), 0)) AS potbus_per_1k FROM k"""),
    "land_shading": r("land_share", f"WITH u AS ({U}), s AS (SELECT *, {share_pair('aland', 'awater')} FROM u) SELECT area_id, land_share FROM s WHERE (aland > 0 AND land_share >= 0.2) OR NOT EXISTS (SELECT 1 FROM s WHERE aland > 0 AND land_share >= 0.2)"),
    "first_of_each_borough": with_(u, last="SELECT borough, area_id, exclusion FROM (SELECT *, row_number() OVER (PARTITION BY borough ORDER BY exclusion, row_ord) AS n FROM u) WHERE n = 1"),
    "pass_rate": r("rate", with_(u, last="SELECT area_id, coalesce(select_count / nullif(eligible_runs * (row_ord % 5), 0)::DOUBLE, 0.0) AS rate FROM u")),
    "anchor_snap": with_(u, anchors, snapped, last="SELECT anchor_idx, area_id FROM sn"),
    "drop_anchors": with_(u, anchors, snapped, distinct, last="SELECT area_id, borough FROM u WHERE area_id NOT IN (SELECT area_id FROM a0)"),
    "external_exclusion": with_(u, last="SELECT area_id, borough FROM u WHERE row_ord NOT IN (SELECT s_suppkey FROM supplier)"),
    "feature_covariance": r("cov", with_(u, uz, last=" UNION ALL ".join(f"SELECT '{Z[i]}' AS i, '{Z[j]}' AS j, covar_samp({Z[i]}, {Z[j]}) AS cov, count(*) AS n FROM uz" for i in range(6) for j in range(i, 6))), 4),
    "assign_nearest_centroid": r("dist2", with_(*vec, last=f"SELECT vec_id, arg_min(label, {{'d': d, 'l': label}}) AS nearest, min(d) AS dist2 FROM (SELECT v.vec_id, c.label, {sq('v.e', 'c.c')} AS d FROM v, c) GROUP BY vec_id")),
    "cluster_sizes_imbalance": r("small_fraction imbalance_std imbalance_range", with_(*vec, validity[-1], last="SELECT * FROM cs")),
    "silhouette_exact": r("silhouette", with_(*validity, last="SELECT * FROM sl")),
    "calinski_harabasz": r("calinski_harabasz", with_(*validity, last="SELECT * FROM ch")),
    "davies_bouldin": r("davies_bouldin", with_(*validity, last="SELECT * FROM db")),
    "trial_scores": r("map_score run_score", with_(*validity, last="SELECT silhouette + 0.0005 * calinski_harabasz - 0.5 * davies_bouldin - 0.5 * small_fraction - 0.1 * imbalance_std AS map_score, silhouette - 0.5 * davies_bouldin - 0.05 * small_clusters - 0.1 * imbalance_range AS run_score FROM sl, ch, db, cs")),
    "effective_weights": r("weight share", "WITH w AS (SELECT feature, sqrt(sum(pow(((c * 7 + i * 3) % 11 - 5) / 10.0::DOUBLE * ((c % 4 + 1) / 4.0::DOUBLE), 2))) AS weight FROM range(6) a(c), (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES)) + ") f(i, feature) GROUP BY feature) SELECT feature, weight, weight / (SELECT sum(weight) FROM w) AS share FROM w"),
    "ladder_schedule": r("t fdr_alpha min_pass_rate store_buffer_mi ring_fallback_mi demand max_search_mi", steps[1]),
    "haversine_bearing_octant": r("miles bearing", with_(u, anchors, last=f"SELECT anchor_idx, area_id, miles, bearing, {octant('bearing')} AS octant FROM (SELECT anchor_idx, area_id, {hav('anchor_lat', 'anchor_lon', 'lat', 'lon')} AS miles, {bearing('anchor_lat', 'anchor_lon', 'lat', 'lon')} AS bearing FROM u, an)")),
    "range_join_neighbors": r("dist_mi", with_(u, edges(2.5), last="SELECT * FROM e")),
    "proximity_adjacency": r("dist_mi", with_(u, edges(0.35), last="SELECT * FROM e")),
    "demand_rings": r("ring_mi", with_(*found[:-1], last="SELECT src, scenario_idx, ring_mi FROM rg")),
    "ladder_candidates": r("ring_mi ring_used_mi", with_(*found, last="SELECT scenario_idx, area_id, ring_mi, ring_used_mi FROM cd")),
    "ladder_kept": r("ring_used_mi", with_(*kept, recursive=True, last="SELECT scenario_idx, area_id, kept_rank, ring_used_mi FROM kp")),
    "ladder_summary": r("t total_potentialbus avg_passrate med_ring", with_(*kept, recursive=True, last="SELECT scenario_idx, any_value(st.t) AS t, count(kp.area_id) AS kept_count, coalesce(sum(kp.potential_bus), 0.0) AS total_potentialbus, coalesce(avg(kp.pass_rate), 0.0) AS avg_passrate, coalesce(quantile_cont(kp.ring_used_mi, 0.5), 0.0) AS med_ring, count(*) FILTER (kp.borough = 'Bronx') AS borough_bronx, count(*) FILTER (kp.borough = 'Unknown') AS borough_unknown FROM st LEFT JOIN kp USING (scenario_idx) GROUP BY scenario_idx")),
    "ladder_aggregate": r("t_first t_last ring_med lat lon pass_rate_med pbus_sum pass_rate ladder_freq robustness", with_(*kept, by_area, recursive=True, last="SELECT * FROM ba")),
    "final_shortlist": r("robustness pass_rate", with_(*kept, by_area, recursive=True, last="SELECT CAST(row_number() OVER (ORDER BY robustness DESC, ladder_count DESC, pass_rate DESC, area_id) AS INTEGER) AS shortlist_rank, area_id, robustness, ladder_count, pass_rate FROM ba QUALIFY shortlist_rank <= 10")),
    "borough_variances": r("variance", with_(u, uz, *models, last="SELECT borough, CAST(i - 1 AS INTEGER) AS i, variances[i] AS variance FROM mm, range(1, 7) t(i)")),
    "mahalanobis_pairs": r("d2", with_(*base, near, last="SELECT * FROM nd")),
    "twin_threshold": r("threshold", with_(*base, near, limits, last="SELECT * FROM th")),
    "adjacent_twin_gate": with_(*base, close, limits, last="SELECT a.anchor, count(nd.d2) FILTER (nd.d2 <= 0.95 * th.threshold) AS hits, count(nd.d2) FILTER (nd.d2 <= 0.95 * th.threshold) >= 1 AS has_twin FROM a JOIN th USING (anchor) LEFT JOIN nd USING (anchor) GROUP BY a.anchor"),
    "octant_rays": r("dist_mi", with_(*base, members, last=f"SELECT anchor, octant, area_id, dist_mi FROM (SELECT *, row_number() OVER (PARTITION BY anchor, octant ORDER BY dist_mi DESC, area_id) AS n FROM (SELECT *, {octant('bearing')} AS octant FROM (SELECT m.anchor, m.area_id, {hav('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS dist_mi, {bearing('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS bearing FROM mb m JOIN a USING (anchor) JOIN p ON p.area_id = m.area_id WHERE m.anchor <> m.area_id)) WHERE dist_mi <= 1.2) WHERE n = 1")),
    "cluster_profile_rows": r("anch_gap max_radius_mi mean_radius_mi adj_density", with_(*profiles, last="SELECT anchor, borough, cluster_size, n_twins, array_to_string([format('{:.4f}', round(x, 4) + 0.0) FOR x IN mu], ',') AS mu, round(list_sum(cov), 4) + 0.0 AS cov_sum, anch_gap, max_radius_mi, mean_radius_mi, adj_density FROM pf")),
    "ab_breakdown": r([f"dist_{k}" for k in WEIGHTS] + ["composite_dist"], with_(*profiles, *pairs, last=f"SELECT a_anchor, b_anchor, {', '.join(f'dist_{k}' for k in WEIGHTS)}, composite_dist, round(similarity_pct, 4) + 0.0 AS similarity_pct FROM d2")),
    "ab_top1": with_(*profiles, *pairs, last="SELECT a_anchor, b_anchor, round(similarity_pct, 4) + 0.0 AS similarity_pct FROM (SELECT *, row_number() OVER (PARTITION BY a_anchor ORDER BY similarity_pct DESC, b_anchor) AS n FROM d2 WHERE a_anchor <> b_anchor) WHERE n = 1"),
    "map_layer_ranked": with_(("u0", U), ("u", f"SELECT *, {share_pair('aland', 'awater')} FROM u0"), uz, score, ("gr", "SELECT borough, row_number() OVER (ORDER BY avg(location_score) DESC, borough) AS k FROM s GROUP BY borough"),
        last=f"SELECT area_id, CASE WHEN o THEN 'excluded' ELSE 'ranked' END AS layer, CASE WHEN land_share < 0.1 THEN '#ffffff' WHEN o THEN '#bdbdbd' ELSE {list(RANK_COLORS)}[1 + (k - 1) % 8] END AS fill, CAST(CASE WHEN land_share < 0.1 THEN 0.0 WHEN o THEN 0.4 WHEN row_ord % 4 = 0 THEN 1.2 ELSE 0.25 END AS DOUBLE) AS weight, CAST(CASE WHEN land_share < 0.1 THEN 0.0 WHEN o THEN 0.6 ELSE 0.7 END AS DOUBLE) AS opacity FROM (SELECT s.*, gr.k, lower(trim(exclusion)) <> 'no' AS o FROM s JOIN gr USING (borough))"),
    "map_bounds": r("south west north east centre_lat centre_lon", with_(u, last="SELECT min(lat) - 0.01 AS south, min(lon) - 0.01 AS west, max(lat) + 0.01 AS north, max(lon) + 0.01 AS east, (min(lat) + max(lat)) / 2 AS centre_lat, (min(lon) + max(lon)) / 2 AS centre_lon FROM u")),
}
boxes = ("bx", "SELECT p_partkey AS area_id, (p_partkey % 40)::DOUBLE * 2 AS x1, floor(p_partkey / 40.0) * 2 AS y1, (p_partkey % 40)::DOUBLE * 2 + (p_partkey % 3 + 1) AS x2, floor(p_partkey / 40.0) * 2 + (p_partkey % 2 + 1) AS y2, p_size / 16.0::DOUBLE AS s FROM part")
ORACLES["box_queen_adjacency"] = with_(boxes, last="SELECT a.area_id AS src, b.area_id AS dst FROM bx a JOIN bx b ON a.area_id <> b.area_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2")
ORACLES["box_overlay_share"] = r("share", with_(boxes, ("cv", "SELECT x1 + 0.5 AS x1, y1 + 0.25 AS y1, x1 + 0.5 + s AS x2, y1 + 1.25 AS y2 FROM bx"),
    ("it", "SELECT b.area_id, greatest(b.x1, c.x1) AS x1, greatest(b.y1, c.y1) AS y1, least(b.x2, c.x2) AS x2, least(b.y2, c.y2) AS y2 FROM bx b JOIN cv c ON b.x1 < c.x2 AND c.x1 < b.x2 AND b.y1 < c.y2 AND c.y1 < b.y2"),
    ("ex", "SELECT area_id, x AS lo, lead(x) OVER (PARTITION BY area_id ORDER BY x) AS hi FROM (SELECT DISTINCT area_id, unnest([x1, x2]) AS x FROM it)"),
    ("ey", "SELECT area_id, y AS lo, lead(y) OVER (PARTITION BY area_id ORDER BY y) AS hi FROM (SELECT DISTINCT area_id, unnest([y1, y2]) AS y FROM it)"),
    ("ar", "SELECT x.area_id, sum((x.hi - x.lo) * (y.hi - y.lo)) AS covered FROM ex x JOIN ey y USING (area_id) WHERE EXISTS (SELECT 1 FROM it WHERE it.area_id = x.area_id AND it.x1 <= x.lo AND it.x2 >= x.hi AND it.y1 <= y.lo AND it.y2 >= y.hi) GROUP BY x.area_id"),
    last="SELECT area_id, least(greatest(coalesce(covered, 0.0) / ((x2 - x1) * (y2 - y1)), 0.0), 1.0) AS share FROM bx LEFT JOIN ar USING (area_id)"))

step_d2 = "list_sum([(g.z[i] - p.z[i]) * (g.z[i] - p.z[i]) / a.variances[i] FOR i IN range(1, 7)])"
growth = ("gr", f"""SELECT anchor, 0 AS level, [anchor] AS front, [anchor] AS seen, [{{'id': anchor, 'd2': 0.0::DOUBLE, 'level': 0}}] AS acc FROM a
  UNION ALL SELECT b.anchor, b.level + 1, x.front, list_concat(b.seen, x.tested), list_concat(b.acc, x.rows) FROM gr b, LATERAL (
    SELECT coalesce(list(id ORDER BY pos, id) FILTER (WHERE ok), []) AS front, coalesce(list(id), []) AS tested, coalesce(list({{'id': id, 'd2': d2, 'level': b.level + 1}}) FILTER (WHERE ok), []) AS rows FROM (
      SELECT t.id, t.pos, {d2} AS d2, {d2} <= th.threshold AND {step_d2} <= 0.95 * th.threshold AS ok FROM (
        SELECT e.dst AS id, min(f.pos) AS pos, arg_min(f.fid, f.pos) AS by_id FROM (SELECT unnest(b.front) AS fid, generate_subscripts(b.front, 1) AS pos) f JOIN e ON e.src = f.fid WHERE NOT list_contains(b.seen, e.dst) GROUP BY e.dst) t
      JOIN p ON p.area_id = t.id JOIN p g ON g.area_id = t.by_id JOIN a ON a.anchor = b.anchor JOIN th ON th.anchor = b.anchor WHERE {hav('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 1.2)) x WHERE len(b.front) > 0""")
grown = ("tw", "SELECT anchor, unnest(acc) AS m FROM (SELECT anchor, arg_max(acc, level) AS acc FROM gr GROUP BY anchor)")
ORACLES["twin_clusters"] = r("d2", with_(*base, near, limits, growth, grown, recursive=True, last="SELECT anchor, m.id AS area_id, m.d2 AS d2, CAST(m.level AS INTEGER) AS level FROM tw"))
ORACLES["twin_cluster_sizes"] = with_(*base, near, limits, growth, grown, recursive=True, last="SELECT anchor, count(*) AS cluster_size, count(*) - 1 AS n_twins FROM tw GROUP BY anchor")
