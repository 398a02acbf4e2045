"""Operators against plain Python on small random tables, and edge cases."""

import inspect
import json
import math
import random
import time

import numpy as np
import pytest

from plotwise.operators import features, ladder, montecarlo, polygons, search, spatial, stats, twins
from plotwise.plans import queries as plans
from plotwise.sources import config, files


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.7613 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def places():
    rnd = random.Random(3)
    return [(f"{i:04d}", 40.5 + rnd.random() * 0.06, -74.0 + rnd.random() * 0.06) for i in range(120)]


def test_range_join(spark, places):
    df = spark.createDataFrame([*places, ("nowhere", None, None)], "area_id string, lat double, lon double")
    got = {(r["src"], r["dst"]) for r in spatial.range_join(df, df, 0.7).collect()}
    assert got == {(a[0], b[0]) for a in places for b in places if a != b and hav(*a[1:], *b[1:]) <= 0.7}


def test_greedy_both_ways(spark, places):
    rnd = random.Random(5)
    rows = [(s, p[0], i, p[1], p[2], rnd.choice([0.5, 0.6, 0.7]), rnd.randrange(3), rnd.choice([0.3, 0.6, 1.0])) for s in range(3) for i, p in enumerate(places)]
    want = set()
    for s in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[5], -r[6], r[2])):
            if len(kept) < 15 and all(hav(r[3], r[4], k[3], k[4]) >= max(r[7], k[7]) for k in kept):
                kept.append(r)
        want |= {(s, r[1], n + 1) for n, r in enumerate(kept)}
    df = spark.createDataFrame(rows, "scenario_idx int, area_id string, row_ord int, lat double, lon double, pass_rate double, select_count int, ring_used_mi double")
    for most in (100_000, 10):
        assert {tuple(r) for r in ladder.spaced(df, most_folded=most).collect()} == want


def test_ring_steps_need_no_table_of_pairs(spark, places):
    rnd = random.Random(7)
    rows = [(*p, float(rnd.randrange(4))) for p in places]
    far = [("far", 41.5, -73.0, 1.0), ("nowhere", None, None, 1.0)]
    df = spark.createDataFrame([*rows, *far], "area_id string, lat double, lon double, weight double")
    steps = spark.createDataFrame([(k, float(d), m) for k, (d, m) in enumerate([(1, 2.0), (5, 2.0), (12, 2.0), (12, 0.3), (400, 2.0)])], "scenario_idx int, demand double, max_search_mi double")
    pairs = spatial.cumulative_weights(spatial.range_join(df, df, 2.0), df)
    want = {tuple(r) for r in spatial.demand_rings(pairs, steps).collect()}
    for enough in (12.0, 400.0):
        near = spatial.ring_steps(df, df, 2.0, enough, pairs_each=8)
        reached = steps.where(f"demand <= {enough}")
        got = {tuple(r) for r in spatial.demand_rings(near, reached).collect()}
        assert got == {r for r in want if r[1] < (4 if enough < 400 else 5)} and got
    assert spatial.ring_steps(df, df, 2.0, 12.0, pairs_each=8).count() < pairs.count() / 3


def test_chosen_in_several_lists(spark, places):
    rnd = random.Random(11)
    rows = [(0, p[0], i, p[1], p[2], 0.5, 1, rnd.choice([0.8, 1.0, 1.5])) for i, p in enumerate(places)] + [(1, p[0], i, p[1], p[2], 0.5, 1, 3.0) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, "scenario_idx int, area_id string, row_ord int, lat double, lon double, pass_rate double, select_count int, ring_used_mi double")
    whole = {tuple(r) for r in ladder.kept_sites(df, most_folded=1000).collect()}
    assert whole == {tuple(r) for r in ladder.kept_sites(df, most_folded=3).collect()} and len({r[0] for r in whole}) == 2


def test_twins_by_miles_as_by_edges(spark, places):
    rnd = np.random.default_rng(6)
    points = spark.createDataFrame([(p[0], "x", p[1], p[2], [float(v) for v in rnd.normal(size=2)]) for p in places], "area_id string, borough string, lat double, lon double, z array<double>").localCheckpoint()
    anchored = twins.anchor_rows(spark.createDataFrame([(p[0],) for p in places[:6]], "area_id string"), points, spark.createDataFrame([(None, [1.0, 1.0])], "borough string, variances array<double>"))
    limits = spark.createDataFrame([(p[0], 2.0) for p in places[:6]], "anchor string, threshold double")
    edges = spatial.range_join(points, points, 0.8)
    members = spatial.around(anchored, points, 1.2, "a_lat", "a_lon").select("anchor", "area_id")
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    for f in (
        lambda e: twins.neighbour_distances(anchored, e, points), lambda e: twins.contiguous_twins(anchored, e, points, limits), lambda e: twins.ray_walk(anchored, e, points, limits),
        lambda e: twins.profiles(anchored, members, points, e).select("anchor", "cluster_size", "adj_density"),
    ):
        assert rounded(f(0.8)) == rounded(f(edges)) != []


def test_thresholds_take_the_whole_borough(spark):
    z = np.random.default_rng(7).normal(size=(2400, 2))
    points = spark.createDataFrame([(f"{i:04d}", "x" if i < 2000 else "y", 40.0 + i, -74.0, [float(v) for v in z[i]]) for i in range(2400)], "area_id string, borough string, lat double, lon double, z array<double>")
    anchored = twins.anchor_rows(spark.createDataFrame([("0000",), ("2000",)], "area_id string"), points, spark.createDataFrame([(None, [1.0, 2.0])], "borough string, variances array<double>"))
    near = spark.createDataFrame([("0000", "0001", 50.0)] + [("2000", f"{i:04d}", float(i)) for i in range(2001, 2009)], "anchor string, area_id string, d2 double")
    got = {r["anchor"]: (r["threshold"], r["n_values"]) for r in twins.thresholds(anchored, near, points).collect()}
    d2 = ((z[1:2000] - z[0]) ** 2 / [1.0, 2.0]).sum(1)
    assert got == {"0000": (pytest.approx(np.quantile([*d2, 50.0], 0.95)), 2000), "2000": (pytest.approx(np.quantile(range(2001, 2009), 0.95)), 8)}


def test_twins_first_come_first_served(spark, places):
    rnd = np.random.default_rng(1)
    z = {p[0]: rnd.normal(size=2) for p in places}
    at = {p[0]: p[1:] for p in places}
    edges = sorted((a, b) for a in at for b in at if a != b and hav(*at[a], *at[b]) <= 0.8)
    near = {a: [b for x, b in edges if x == a] for a in at}
    points = spark.createDataFrame([(p[0], "x", p[1], p[2], [float(v) for v in z[p[0]]]) for p in places], "area_id string, borough string, lat double, lon double, z array<double>")
    anchors = [p[0] for p in places[:25]]
    anchored = twins.anchor_rows(spark.createDataFrame([(a,) for a in anchors], "area_id string"), points, spark.createDataFrame([(None, [1.0, 1.0])], "borough string, variances array<double>"))
    limits = spark.createDataFrame([(a, 2.0) for a in anchors], "anchor string, threshold double")
    want = set()
    for a in anchors:
        line, seen = [a], {a}
        want.add((a, a))
        while line:
            cur = line.pop(0)
            for b in near[cur]:
                if b in seen or hav(*at[a], *at[b]) > 1.2:
                    continue
                seen.add(b)
                if ((z[a] - z[b]) ** 2).sum() <= 2.0 and ((z[cur] - z[b]) ** 2).sum() <= 0.95 * 2.0:
                    want.add((a, b))
                    line.append(b)
    got = twins.contiguous_twins(anchored, spark.createDataFrame(edges, "src string, dst string"), points, limits)
    assert {(r["anchor"], r["area_id"]) for r in got.collect()} == want


def test_silhouette_and_search_agree(spark):
    rnd = np.random.default_rng(2)
    x, labels = rnd.normal(size=(60, 3)), rnd.integers(0, 4, 60)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], int(labels[i])) for i in range(60)], "vec_id long, embedding array<double>, label int")
    assert stats.silhouette(df, "vec_id", "label", tile_rows=7).first()[0] == pytest.approx(search.silhouette(x, labels))
    assert stats.davies_bouldin(df, "label").first()[0] == pytest.approx(search.davies_bouldin(x, labels))
    assert stats.calinski_harabasz(df, "label").first()[0] == pytest.approx(search.calinski_harabasz(x, labels))


def test_search_takes_all_rows(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(4400, 2))
    df = spark.createDataFrame([(f"{i:04d}", float(p), float(q)) for i, (p, q) in enumerate(x)], "area_id string, a_z double, b_z double")
    made = search.search(df, ["a_z", "b_z"], [3], 2, restarts=1).collect()
    assert len(made) == 2 and all(sum(r["sizes"]) == 3300 for r in made)
    with pytest.raises(ValueError):
        search.search(df, ["a_z", "b_z"], [3], 2, most_rows=4399)
    labels = rnd.integers(0, 3, 300)
    assert search.silhouette(x[:300], labels, tile_rows=7) == pytest.approx(search.silhouette(x[:300], labels))
    assert plans.pca_kmeans_search(spark, "/root/testdata/sf0.001").count() == 80


def plain_lloyd(x, centres, most_steps=100):
    for _ in range(most_steps):
        d = search.distances2(x, centres)
        at = d.argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        new = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            new[n == 0] = x[d.min(axis=1).argsort()[::-1][: (n == 0).sum()]]
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-6:
            break
    return centres, search.distances2(x, centres).min(axis=1).sum()


def test_kmeans_agrees_with_full_passes_in_far_less_time(monkeypatch):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(4000, 6))
    starts = x[rnd.integers(0, len(x), (20, 10))]
    starts[3, 7] = 100.0  # a centre without points
    began = time.process_time()
    plain = [plain_lloyd(x, c) for c in starts]
    middle = time.process_time()
    centres, costs = search.lloyd(x, starts)
    assert 2 * (time.process_time() - middle) < middle - began
    assert np.allclose(centres, [c for c, _ in plain]) and np.allclose(costs, [c for _, c in plain])
    monkeypatch.setattr(search, "TILE", 100)
    assert np.allclose(search.lloyd(x, starts[:4])[0], centres[:4])
    whole = search.kmeans(x, 5, 4, np.random.default_rng(1))
    monkeypatch.setattr(search, "BATCH", 1)  # each start alone
    assert np.allclose(search.kmeans(x, 5, 4, np.random.default_rng(1)), whole)
    for k, points in ((1, x[:9]), (3, np.zeros((5, 2))), (4, np.repeat(x[:2], 3, 0))):
        assert search.kmeans(points, k, 3, np.random.default_rng(0)).shape == (k, points.shape[1])


def test_kmeans_decides_near_ties_exactly():
    rnd = np.random.default_rng(10)
    grid = rnd.integers(0, 4, (3000, 3)) + 1e-7 * rnd.normal(size=(3000, 3))  # midway between centres but for 1e-7
    far = np.vstack([rnd.normal(size=(2000, 3)), [[1e4, 0.0, 0.0]]])
    for x in (grid, far):
        starts = x[rnd.integers(0, len(x), (6, 5))]
        for steps in (1, 2, 7):
            want = [plain_lloyd(x - x.mean(0), c - x.mean(0), steps) for c in starts]
            centres, costs = search.lloyd(x, starts, steps)
            assert np.allclose(centres, [c + x.mean(0) for c, _ in want], rtol=0, atol=1e-9 * np.abs(x).max())
            assert np.allclose(costs, [c for _, c in want], rtol=1e-7, atol=1e-9)


def test_few_points_meet_without_bounds(monkeypatch):
    rnd = np.random.default_rng(11)
    x, labels = rnd.normal(size=(700, 3)), rnd.integers(0, 5, 700)
    bounded, asked = search.may_be_nearest, []
    monkeypatch.setattr(search, "may_be_nearest", lambda *a: asked.append(1) or bounded(*a))
    assert search.silhouette(x, labels) == pytest.approx(all_pairs_silhouette(x, labels), abs=1e-8) and not asked
    monkeypatch.setattr(search, "FEW", 600)
    assert search.silhouette(x, labels) == pytest.approx(all_pairs_silhouette(x, labels), abs=1e-8) and asked


def test_robust_scale_of_flat_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (float("nan"), None)], "a double, b double")
    assert [tuple(r)[2:] for r in features.robust_scale(df, ["a", "b"]).collect()] == [(0.0, 0.0)] * 3


def test_monte_carlo_resumes(spark, tmp_path):
    rnd = np.random.default_rng(4)
    cols = ["a_z", "b_z"]
    df = spark.createDataFrame([(f"{i:03d}", float(p), float(q)) for i, (p, q) in enumerate(rnd.normal(size=(80, 2)))], "area_id string, a_z double, b_z double")
    small = dict(ks=(3,), n=2, restarts=2)
    whole = {tuple(r) for r in montecarlo.counts(montecarlo.runs(df, cols, n_runs=3, **small)).collect()}
    path = str(tmp_path / "runs")
    asked = iter([False, True])
    montecarlo.resumed(df, cols, path, 3, batch=2, stop=lambda: next(asked), **small)
    assert {tuple(r) for r in montecarlo.resumed(df, cols, path, 3, batch=2, **small).collect()} == whole


def test_monte_carlo_query_is_the_whole_job(spark, monkeypatch):
    asked = {}

    def runs(*args, **options):
        bound = inspect.signature(whole).bind(*args, **options)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return spark.createDataFrame([(0, "a", 1, True)], "run int, area_id string, cluster_rank int, selected boolean")

    whole = montecarlo.runs
    monkeypatch.setattr(montecarlo, "runs", runs)
    assert plans.monte_carlo_counts(spark, "/root/testdata/sf0.001").count() == 1
    assert (asked["n_runs"], asked["ks"], asked["n"], asked["restarts"]) == (100, (6, 8, 10, 12), 32, 20)


def test_overlay_counts_overlaps_once(spark):
    kind = "x1 double, y1 double, x2 double, y2 double"
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 5.0, 5.0, 6.0, 6.0)], f"area_id string, {kind}")
    covers = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0), (0.5, 0.0, 1.0, 2.0)], kind)
    assert {r[0]: r[1] for r in polygons.overlay_share(boxes, covers, 1.0).collect()} == {"a": 0.5, "b": 0.0}


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "f.csv").write_text("GEOID,pop\n60050001001,5\n,7\n1500000US360050001001,x\n")
    got = files.features_csv(spark, str(tmp_path / "f.csv"), ["pop", "none"]).select("area_id", "pop", "none").collect()
    assert {tuple(r) for r in got} == {("060050001001", 5.0, None), ("360050001001", None, None)}
    assert {r[0] for r in files.excluded_ids(spark, str(tmp_path / "f.csv")).collect()} == {"060050001001", "360050001001"}
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}]}')
    shapes = files.geojson(spark, str(tmp_path / "g.json"), "id")
    assert polygons.ring_areas(shapes).first()["area"] == 4.0
    (tmp_path / "c.json").write_text('{"40.500000,-74.000000": "here"}')
    points = spark.createDataFrame([(40.5, -74.0), (1.0, 1.0)], "lat double, lon double")
    assert [r["label"] for r in files.with_labels(points, files.geocode_cache(spark, str(tmp_path / "c.json"))).orderBy("lat").collect()] == [None, "here"]
    monkeypatch.setenv("STEPS", "7.0")
    assert config.setting({"a": {"b": 3}}, "STEPS", "a.b", 1) == 7 and config.setting({"a": {"b": 3}}, "NONE", "a.b", 1) == 3
    monkeypatch.setenv("STEPS", "  ")
    assert config.setting({"a": {"b": 3}}, "STEPS", "a.b", 1) == 3 and config.setting({"a": {"b": [4]}}, "STEPS", "a.b", 1) == 1
    monkeypatch.setenv("STEPS", "T")
    assert config.setting({}, "STEPS", "a", False) is True
    monkeypatch.setenv("STEPS", "6, 8.5,x")
    assert config.setting({}, "STEPS", "a", [1]) == [6, 8.5, "x"]


def test_multipolygons(spark, tmp_path):
    square = lambda x, side: [[x, 0], [x + side, 0], [x + side, side], [x, side], [x, 0]]
    shapes = [("a", "MultiPolygon", [[square(0, 4), square(1, 1)], [square(10, 2)]]), ("b", "Polygon", [square(0, 1)]), ("c", "Point", [0, 0])]
    features = [{"properties": {"id": i}, "geometry": {"type": kind, "coordinates": at}} for i, kind, at in shapes]
    (tmp_path / "m.json").write_text(json.dumps({"features": [*features, {"properties": {"id": "d"}, "geometry": None}]}))
    got = polygons.ring_areas(files.geojson(spark, str(tmp_path / "m.json"), "id")).collect()
    assert {(r["area_id"], r["area"], r["x1"], r["x2"]) for r in got} == {("a", 19.0, 0.0, 12.0), ("b", 1.0, 0.0, 1.0)}


def test_sizes_count_every_label(spark):
    points = spark.createDataFrame([(x,) for x in [0, 0, 0, 1, 5, 5]], "label int")
    got = stats.cluster_sizes(points, "label", 3, 2).first()
    n = np.bincount([0, 0, 0, 1, 5, 5], minlength=3)
    assert (got["smallest"], got["largest"], got["small_clusters"], got["small_fraction"]) == (0, 3, 4, pytest.approx(4 / 6))
    assert got["imbalance_std"] == pytest.approx(n.std() / n.mean())


def all_pairs_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    names, n = np.unique(labels, return_counts=True)
    sums = np.stack([d[:, labels == c].sum(1) for c in names], 1)
    own = labels[:, None] == names
    a, b = (sums * own).sum(1) / np.maximum((n * own).sum(1) - 1, 1), np.where(own, np.inf, sums / n).min(1)
    return np.where((n * own).sum(1) == 1, 0.0, (b - a) / np.maximum(a, b)).mean()


def test_silhouette_meets_near_clusters_only_and_stays_exact():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(900, 4)) + 1e3
    for labels in (x[:, 0].argsort().argsort() // 150, rnd.integers(0, 6, 900), np.minimum(np.arange(900), 3)):
        assert search.silhouette(x, labels, tile_rows=64) == pytest.approx(all_pairs_silhouette(x, labels), abs=1e-8)
    copies = np.repeat(x[:30], 20, 0)
    assert search.silhouette(copies, np.repeat(np.arange(30) % 4, 20)) == pytest.approx(all_pairs_silhouette(copies, np.repeat(np.arange(30) % 4, 20)), abs=1e-6)
    x = rnd.normal(size=(4000, 2))
    labels = ((x[:, 0] > 0) + 2 * (x[:, 1] > 0)).astype(int)
    some = search.may_be_nearest(x, labels, [x[labels == c] for c in range(4)])
    mean = np.stack([np.sqrt(((x[:, None] - x[labels == c][None]) ** 2).sum(2)).mean(1) for c in range(4)], 1)
    mean[np.arange(4000), labels] = np.inf
    assert some[np.arange(4000), mean.argmin(1)].all() and some.sum() < 1.5 * 4000


def test_starts_spread_over_the_cluster_give_the_same_centres(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(500, 3))
    monkeypatch.setattr(search, "BATCH", 4000)  # two starts a task
    assert np.allclose(search.spread_kmeans(spark, x, 4, 7, np.random.default_rng(1)), search.kmeans(x, 4, 7, np.random.default_rng(1)))
