"""The registered queries of the location-analytics engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, ids
from ..functions.numeric import to_number
from ..functions.tables import settled
from ..operators import features, ladder, layers, montecarlo, polygons, search, similarity, spatial, stats, twins
from . import universe as u

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIRTY_IDS = (None, "", "1500000US360050001001", "360050001001.0", "3.60050001001E11", "60050001001", " 360050001001 ", "3600500010011", "36-047-000100.1", "nodigits", "360610001001", "360810001001", "360850001001")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: u.rounded(f(spark, sf_dir))
    return f


@query
def normalize_ids(spark, sf):
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(DIRTY_IDS)], "n int, raw string")
    mended = raw.withColumns({"normalized": ids.normalize_id(F.col("raw")), "canonical": ids.canonical_id(F.col("raw")), "plain": ids.plain_id(F.col("raw"))})
    return mended.select("n", "normalized", "canonical", "plain", ids.borough_of(F.col("normalized")).alias("borough"), ids.block_area(F.col("normalized")).alias("area"))


@query
def exclusion_ledger(spark, sf):
    a = features.with_shares(u.areas(spark, sf))
    return features.exclusion_ledger(a.where("aland > 20").select("area_id", "open_space_share", "land_share"), a.where("median_income > -900").select("area_id", "exclusion"), "area_id")


@query
def land_water_shares(spark, sf):
    blocks = u.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("area_id"), F.col("l_quantity").alias("land"), F.round(F.col("l_discount") * 100, 0).alias("water"))
    return features.shares_by_area(blocks, "area_id", "land", "water")


@query
def share_cascade(spark, sf):
    blocks = u.table(spark, sf, "lineitem").join(u.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = features.shares_by_area(blocks.select(F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("area_id"), "l_quantity", F.col("l_linenumber").cast("double").alias("water")), "area_id", "l_quantity", "water")
    return features.fill_shares(u.areas(spark, sf), sums, "area_id").select("area_id", "land_share", "water_share")


@query
def numeric_clean(spark, sf):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.lit("bad")).when(F.col("c_custkey") % 11 == 0, F.lit(" 12.5 ")).otherwise(F.col("c_acctbal").cast("string"))
    return u.table(spark, sf, "customer").select("c_custkey", to_number(raw).alias("value"), to_number(F.col("c_mktsegment")).alias("none"))


@query
def median_impute(spark, sf):
    return features.impute(u.areas(spark, sf), ["share_college_plus", "pop_density", "p_fdr"]).select("area_id", "share_college_plus", "pop_density", "p_fdr")


@query
def winsorize(spark, sf):
    return features.winsorize(u.areas(spark, sf), features.FEATURES, 0.05).select("area_id", *features.FEATURES)


@query
def log1p_features(spark, sf):
    return features.log_features(u.areas(spark, sf)).select("area_id", *features.LOGGED)


@query
def robust_z(spark, sf):
    return u.scaled(spark, sf).select("area_id", *u.Z)


@query
def prep_cluster_matrix(spark, sf):
    return features.cluster_matrix(u.areas(spark, sf)).select("area_id", *u.Z)


@query
def prep_optimal_matrix(spark, sf):
    return features.selection_matrix(u.areas(spark, sf)).select("area_id", *u.Z)


@query
def location_score(spark, sf):
    return features.location_score(u.scaled(spark, sf)).select("area_id", "location_score")


@query
def rank_groups(spark, sf):
    return features.rank_groups(features.location_score(u.scaled(spark, sf)), "borough")


@query
def cluster_profiles(spark, sf):
    return features.cluster_profiles(u.areas(spark, sf), "borough", features.FEATURES)


@query
def twin_features(spark, sf):
    a = u.areas(spark, sf)
    raw = a.select("area_id", "aland", "potential_bus", *[(F.col("row_ord") * m % k).cast("string").alias(n) for n, m, k in (("edu_total", 7, 90), ("edu_22", 3, 11), ("edu_23", 5, 7), ("edu_24", 2, 5), ("edu_25", 1, 3), ("commute_total", 11, 60), ("commute_60p", 13, 17), ("population", 19, 1500), ("occupied", 23, 700), ("competitors", 29, 9))])
    return features.twin_features(raw).select("area_id", "share_college_plus", "share_commute_60p", "pop_density", "occ_units_density", "comp_per_km2", "potbus_per_1k")


@query
def land_shading(spark, sf):
    return features.land_shading(features.with_shares(u.areas(spark, sf))).select("area_id", "land_share")


@query
def first_of_each_borough(spark, sf):
    return features.first_of_each(u.areas(spark, sf), "borough", ["exclusion", "row_ord"]).select("borough", "area_id", "exclusion")


@query
def pass_rate(spark, sf):
    return u.areas(spark, sf).select("area_id", features.pass_rate(F.col("select_count"), F.col("eligible_runs") * (F.col("row_ord") % 5).cast("long")).alias("rate"))


@query
def anchor_snap(spark, sf):
    return spatial.snap_anchors(u.areas(spark, sf), spatial.literal_anchors(spark))


@query
def drop_anchors(spark, sf):
    return u.areas(spark, sf).join(u.anchors(spark, sf), "area_id", "left_anti").select("area_id", "borough")


@query
def external_exclusion(spark, sf):
    listed = u.table(spark, sf, "supplier").select(ids.canonical_id(F.concat(F.lit("1500000US"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"))).alias("area_id")).distinct()
    return u.areas(spark, sf).withColumn("area_id", ids.canonical_id(F.col("area_id"))).join(listed, "area_id", "left_anti").select("area_id", "borough")


@query
def feature_covariance(spark, sf):
    return stats.covariance(u.scaled(spark, sf), u.Z).select("i", "j", F.round("cov", 4).alias("cov"), "n")


def vectors(spark, sf):
    return stats.dense(u.table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))


@query
def assign_nearest_centroid(spark, sf):
    points = vectors(spark, sf)
    return stats.nearest_centroid(points, stats.centroids(points, "label"), "vec_id", "label")


@query
def cluster_sizes_imbalance(spark, sf):
    return stats.cluster_sizes(vectors(spark, sf), "label", 12, 45)


@query
def silhouette_exact(spark, sf):
    return stats.silhouette(vectors(spark, sf), "vec_id", "label")


@query
def calinski_harabasz(spark, sf):
    return stats.calinski_harabasz(vectors(spark, sf), "label")


@query
def davies_bouldin(spark, sf):
    return stats.davies_bouldin(vectors(spark, sf), "label")


@query
def trial_scores(spark, sf):
    points = vectors(spark, sf)
    one = stats.silhouette(points, "vec_id", "label").join(F.broadcast(stats.calinski_harabasz(points, "label"))).join(F.broadcast(stats.davies_bouldin(points, "label"))).join(F.broadcast(stats.cluster_sizes(points, "label", 12, 45)))
    return one.select(stats.map_trial_score(*[F.col(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin", "small_fraction", "imbalance_std")]).alias("map_score"), stats.run_trial_score(*[F.col(c) for c in ("silhouette", "davies_bouldin", "small_clusters", "imbalance_range")]).alias("run_score"))


@query
def effective_weights(spark, sf):
    pairs = [(c, f, ((c * 7 + i * 3) % 11 - 5) / 10, (c % 4 + 1) / 4) for c in range(6) for i, f in enumerate(features.FEATURES)]
    return stats.effective_weights(spark.createDataFrame(pairs, "component int, feature string, loading double, w double"))


@query
def pca_kmeans_search(spark, sf):
    found = search.search(settled(features.cluster_matrix(settled(u.areas(spark, sf)))), u.Z, [5], 80, "map")
    return found.select("trial", "k", "score", "sil_val")


@query
def optimal_selection(spark, sf):
    z = settled(features.selection_matrix(settled(u.areas(spark, sf))))  # each median of the features reads the areas
    best = search.best_trial(search.search(z, u.Z, [5, 6, 7, 8], 128, "select", 0.5)).first()
    labelled = search.final_labels(z, u.Z, best["weights"], best["k"], "select")
    return features.rank_groups(features.location_score(labelled), "cluster")


@query
def monte_carlo_counts(spark, sf):
    return montecarlo.counts(montecarlo.runs(u.scaled(spark, sf), u.Z))


@query
def ladder_schedule(spark, sf):
    return ladder.ladder(spark)


@query
def haversine_bearing_octant(spark, sf):
    met = u.areas(spark, sf).join(F.broadcast(spatial.literal_anchors(spark)))
    here = [F.col(c) for c in ("anchor_lat", "anchor_lon", "lat", "lon")]
    return met.select("anchor_idx", "area_id", geo.haversine(*here).alias("miles"), geo.bearing(*here).alias("bearing"), geo.octant(geo.bearing(*here)).alias("octant"))


@query
def range_join_neighbors(spark, sf):
    return u.adjacency(spark, sf, 2.5)


@query
def proximity_adjacency(spark, sf):
    return u.adjacency(spark, sf, 0.35)


@query
def demand_rings(spark, sf):
    return u.rings(spark, sf)


@query
def ladder_candidates(spark, sf):
    return u.candidates(spark, sf).select("scenario_idx", "area_id", "ring_mi", "ring_used_mi")


@query
def ladder_kept(spark, sf):
    return u.kept(spark, sf).select("scenario_idx", "area_id", "kept_rank", "ring_used_mi")


@query
def ladder_summary(spark, sf):
    return ladder.summary(u.kept(spark, sf), ladder.ladder(spark)).select("scenario_idx", "t", "kept_count", "total_potentialbus", "avg_passrate", "med_ring", "borough_bronx", "borough_unknown")


@query
def ladder_aggregate(spark, sf):
    return ladder.by_area(u.kept(spark, sf))


@query
def final_shortlist(spark, sf):
    return ladder.shortlist(ladder.by_area(u.kept(spark, sf))).select("shortlist_rank", "area_id", "robustness", "ladder_count", "pass_rate")


@query
def borough_variances(spark, sf):
    return twins.variance_models(u.scaled(spark, sf), u.Z).select("borough", F.posexplode("variances").alias("i", "variance"))


@query
def mahalanobis_pairs(spark, sf):
    anchored, edges, points = u.twin_base(spark, sf)
    return twins.neighbour_distances(anchored, edges, points)


@query
def twin_threshold(spark, sf):
    anchored, edges, points = u.twin_base(spark, sf)
    return twins.thresholds(anchored, twins.neighbour_distances(anchored, edges, points), points)


@query
def adjacent_twin_gate(spark, sf):
    anchored, edges, points = u.twin_base(spark, sf)
    near = settled(twins.neighbour_distances(anchored, edges, points, twins.RADIUS))
    return twins.adjacent_gate(anchored, near, twins.thresholds(anchored, near, points))


def clusters(base):
    anchored, edges, points = base
    limits = settled(twins.thresholds(anchored, twins.neighbour_distances(anchored, edges, points), points))
    return limits, twins.contiguous_twins(anchored, edges, points, limits)


@query
def twin_clusters(spark, sf):
    return clusters(u.twin_base(spark, sf))[1]


@query
def twin_cluster_sizes(spark, sf):
    return clusters(u.twin_base(spark, sf))[1].groupBy("anchor").agg(F.count("*").alias("cluster_size"), (F.count("*") - 1).alias("n_twins"))


@query
def ray_walk(spark, sf):
    base = u.twin_base(spark, sf)
    return twins.ray_walk(*base, settled(twins.thresholds(base[0], twins.neighbour_distances(*base), base[2])))


@query
def octant_rays(spark, sf):
    base = u.twin_base(spark, sf)
    return twins.octant_rays(base[0], u.near_members(spark, sf, base), base[2])


def member_profiles(spark, sf):
    base = u.twin_base(spark, sf)
    return settled(twins.profiles(base[0], u.near_members(spark, sf, base), base[2], base[1]))


@query
def cluster_profile_rows(spark, sf):
    z = F.array_join(F.transform("mu_vec", lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), ",")
    return member_profiles(spark, sf).select("anchor", "borough", "cluster_size", "n_twins", z.alias("mu"), F.round(F.aggregate("cov_flat", F.lit(0.0), lambda a, x: a + x), 4).alias("cov_sum"), "anch_gap", "max_radius_mi", "mean_radius_mi", "adj_density")


@query
def ab_breakdown(spark, sf):
    p = member_profiles(spark, sf)
    return similarity.breakdown(p, p).select("a_anchor", "b_anchor", *[F.col(f"dist_{k}") for k in similarity.WEIGHTS], "composite_dist", F.round("similarity_pct", 4).alias("similarity_pct"))


@query
def ab_top1(spark, sf):
    p = member_profiles(spark, sf)
    pairs = similarity.breakdown(p, p).where("a_anchor <> b_anchor")
    return similarity.top_match(pairs).select("a_anchor", "b_anchor", F.round("similarity_pct", 4).alias("similarity_pct"))


@query
def map_layer_ranked(spark, sf):
    z = features.location_score(features.robust_scale(features.with_shares(u.areas(spark, sf)), features.FEATURES))
    ranked = features.with_group_rank(z, "borough").withColumnRenamed("group_rank", "cluster_rank").withColumn("cluster", (F.col("row_ord") % 4).cast("int"))
    return layers.ranked_layer(ranked)


@query
def map_layer_ladder(spark, sf):
    return layers.ladder_layer(ladder.by_area(u.kept(spark, sf)))


@query
def map_bounds(spark, sf):
    return spatial.total_bounds(u.areas(spark, sf), 0.01)


@query
def box_overlay_share(spark, sf):
    boxes, covers = u.box_table(spark, sf)
    return polygons.overlay_share(boxes, covers, 4.0)


@query
def box_queen_adjacency(spark, sf):
    return polygons.queen_adjacency(u.box_table(spark, sf)[0], 4.0)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The ten areas with the highest location score, with the rank of their borough."""
    scored = features.location_score(u.scaled(spark, sf))
    ranked = features.with_group_rank(scored, "borough")
    return ranked.orderBy(F.desc("location_score"), "area_id").limit(10).select("area_id", "borough", "group_rank", "location_score")
