"""Density steps against brute force, planted clusters, map documents."""

from __future__ import annotations

import glob
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionwatch.operators import density, hotspots
from regionwatch.session import work_folder
from regionwatch.sources import sinks


def matrix_of(spark, points):
    return spark.createDataFrame([(f"{i:05d}", [float(v) for v in p]) for i, p in enumerate(points)], "zipcode string, x array<double>")


def brute(points, k=2):
    points = np.asarray(points, dtype=float)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    others = d + np.diag(np.full(len(d), np.inf))
    core = np.sort(others, axis=1)[:, k - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    return core, reach


def tree_weight(reach):
    n, inside, total = len(reach), [0], 0.0
    best = reach[0].copy()
    for _ in range(n - 1):
        best[inside] = np.inf
        j = int(np.argmin(best))
        total += best[j]
        inside.append(j)
        best = np.minimum(best, reach[j])
    return total


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    blobs = [rng.normal(c, 0.3, (45, 3)) for c in ((0, 0, 0), (4, 4, 0), (0, 5, 2))]
    copies = np.tile([[9.0, 9.0, 9.0]], (5, 1))
    return np.vstack([*blobs, copies, [[20.0, -20.0, 0.0]]])


@pytest.mark.parametrize("block_size", [16, 5_000])
def test_core_distance_and_tree_match_brute_force(spark, cloud, block_size):
    core, reach = brute(cloud)
    found = hotspots.measure(matrix_of(spark, cloud), 2, block_size)
    got = {r["zipcode"]: r["core"] for r in found.members.collect()}
    assert [got[f"{i:05d}"] for i in range(len(cloud))] == pytest.approx(list(core))
    tree = hotspots.with_copies(density.spanning_tree(found.points, found.boxes), found.members).collect()
    assert len(tree) == len(cloud) - 1
    assert sum(r["w"] for r in tree) == pytest.approx(tree_weight(reach))


@pytest.mark.parametrize("region_points", [120_000, 300])
def test_tree_of_regions_matches_brute_force(spark, monkeypatch, region_points):
    """One region grows the whole tree without a pass; several leave what may lie across them; ties, copies and far groups included."""
    passes, look = [], density._look_farther
    monkeypatch.setattr(density, "_look_farther", lambda *args: passes.append(1) or look(*args))
    rng = np.random.default_rng(6)
    grid = np.stack(np.meshgrid(*[np.arange(8.0)] * 3), -1).reshape(-1, 3) / 4
    points = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(9, 0.2, (200, 3)), grid + 30, grid[:40] + 30, rng.normal(0, 40, (20, 3))])
    _, reach = brute(points)
    found = hotspots.measure(matrix_of(spark, points), 2, 64)
    tree = hotspots.with_copies(density.spanning_tree(found.points, found.boxes, region_points=region_points), found.members).collect()
    assert len(tree) == len(points) - 1
    top = list(range(len(points)))
    for r in tree:
        a, b = int(r["a"]), int(r["b"])
        assert r["w"] == pytest.approx(reach[a, b])
        top = [top[a] if t == top[b] else t for t in top] if top[a] != top[b] else pytest.fail("a cycle")
    assert sum(r["w"] for r in tree) == pytest.approx(tree_weight(reach)) and bool(passes) == (region_points == 300)


def test_what_lies_beyond_a_region_limits_it():
    """Cells tell no more than the distance to the nearest box beyond, and join no group that a nearer point may lie outside of."""
    rng = np.random.default_rng(9)
    x, low = rng.normal(0, 1, (700, 3)), rng.normal(0, 6, (90, 3))
    high = low + rng.uniform(0, 1, low.shape)
    told, true = density._Cells(x, np.zeros(700, dtype=int)).beyond(x, low, high), density._gaps(x, low, high).min(axis=1)
    assert (told <= true).all() and (told[true < 1] == true[true < 1]).all()
    points = pd.DataFrame({"id": ["a", "b", "c", "d"], "x": [[0.0], [1.0], [10.0], [13.0]], "core": 0.5, "seen": 0.1, "region": 0})
    edges = pd.DataFrame({c: [] for c in ("p", "q", "a", "b", "w", "sp", "sq", "gp", "gq", "region")})
    out = density._grown(edges, points, np.array([[12.0]]), np.array([[12.5]]))
    assert [tuple(r) for r in out[out["kind"] == "tree"][["a", "b", "w"]].to_numpy()] == [("a", "b", 1.0)]
    alone = density._grown(edges, points, np.zeros((0, 1)), np.zeros((0, 1)))
    assert sorted(alone[alone["kind"] == "tree"]["w"]) == [1.0, 3.0, 9.0]


def test_rounds_and_bounded_finish_agree(spark, cloud):
    _, reach = brute(cloud[:60])
    edges = [(f"{i:05d}", f"{j:05d}", float(reach[i, j])) for i in range(60) for j in range(i + 1, 60) if (i + j) % 3 or j == i + 1]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    few, labels = density.contract(df)
    rounds, round_labels = density.contract(df, finish=0)
    assert few.count() == rounds.count() == 59
    assert few.agg(F.sum("w")).first()[0] == pytest.approx(rounds.agg(F.sum("w")).first()[0])
    assert labels.select("label").distinct().count() == round_labels.select("label").distinct().count() == 1


def test_components_of_planted_blobs(spark, cloud):
    matrix = matrix_of(spark, cloud)
    out = hotspots.components(hotspots.spanning_tree(matrix), matrix, 1.0).orderBy("zipcode").toPandas()["cluster_id"]
    assert list(out[:45]) == [0] * 45 and list(out[45:90]) == [45] * 45 and list(out[90:135]) == [90] * 45
    assert list(out[135:140]) == [135] * 5 and out[140] == -1


def test_hierarchy_of_the_planted_blobs(spark, cloud):
    from test_hierarchy import plain

    _, reach = brute(cloud)
    want = plain(reach, 10, 0.8)
    out = hotspots.memberships(matrix_of(spark, cloud), min_size=10, epsilon=0.8).toPandas().set_index("zipcode")
    assert out["cluster_id"].to_dict() == {f"{i:05d}": min(want[i][0]) if i in want else -1 for i in range(len(cloud))}
    assert [out["cluster_probability"][f"{i:05d}"] for i in want] == pytest.approx([w[1] for w in want.values()])
    assert set(out["cluster_id"]) == {0, 45, 90, -1}


def test_memberships_at_a_distance_follow_density(spark, cloud):
    out = hotspots.memberships_at_distance(matrix_of(spark, cloud), min_size=10, epsilon=1.0).orderBy("zipcode").toPandas()
    core, _ = brute(cloud)
    for blob in range(3):
        rows = slice(blob * 45, (blob + 1) * 45)
        assert set(out["cluster_id"][rows]) == {blob * 45}
        assert list(out["cluster_probability"][rows]) == pytest.approx(list(core[rows].min() / core[rows]))
    assert set(out["cluster_id"][135:]) == {-1} and (out["cluster_probability"][135:] == 0).all()


def test_a_long_chain_is_one_cluster(spark):
    chain = matrix_of(spark, [[i * 0.5] for i in range(6_000)])
    out = hotspots.memberships_at_distance(chain, epsilon=1.0)
    assert out.select("cluster_id").distinct().collect()[0][0] == 0 and out.count() == 6_000


def regions_of(spark, n):
    rows = [(f"{i:05d}", "c", "s", 40.0 + i, -70.0 - i, 10.0 * i, 0.1 * (i % 9), 50.0, 20.0, 0.2 + 0.1 * (i % 6)) for i in range(n)]
    return spark.createDataFrame(rows, "zipcode string, city string, state string, lat double, lon double, pharmacy_sales double, negative_sentiment double, aqi double, er_visits double, disease_risk_score double")


def test_too_few_regions_are_noise(spark):
    out = hotspots.detect(regions_of(spark, 2)).collect()
    assert [(r["cluster_id"], r["cluster_probability"], r["risk_level"]) for r in out] == [(-1, 0.0, "Low")] * 2


def test_map_document_is_valid(spark):
    found = hotspots.detect(regions_of(spark, 12))
    rows = found.collect()
    assert len(rows) == 12 and all(r["cluster_id"] >= -1 and r["risk_level"] in ("Low", "Medium", "High") for r in rows)
    lost = found.withColumn("lat", F.when(F.col("zipcode") != "00003", F.col("lat")))
    path = sinks.write_map_document(lost, work_folder(spark, "map"))
    doc = json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))))
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == doc["metadata"]["n_regions"] == 11
    assert doc["features"][0]["geometry"] == {"type": "Point", "coordinates": [-70.0, 40.0]}
    assert sum(doc["metadata"]["risk_distribution"].values()) == 11


def test_region_without_coordinates_is_noise(spark):
    rows = regions_of(spark, 6).withColumn("lat", F.when(F.col("zipcode") != "00002", F.col("lat")))
    out = {r["zipcode"]: r["cluster_id"] for r in hotspots.detect(rows).collect()}
    assert len(out) == 6 and out["00002"] == -1


def test_only_the_outlier_visits_far_blocks(spark):
    rows = [(str(i), [float(b * 10), i / 100], f"{b}", 0.5 if i else 25.0) for b in range(4) for i in range(20)]
    seekers = spark.createDataFrame(rows, "id string, x array<double>, block string, reach double")
    met = density.visits(seekers, density.Boxes.of(seekers)).collect()
    assert {(r["id"], r["block"], r["target"]) for r in met} == {("0", str(a), str(b)) for a in range(4) for b in range(4) if 0 < abs(a - b) < 3}
