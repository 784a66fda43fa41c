"""Operators on tiles give what they give on whole images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import features, tiles
from rasterloom.plans import scenes


def table(spark, images):
    rows = []
    for name, img in images.items():
        y, x = np.indices(img.shape)
        rows.append(pd.DataFrame({"image": name, "y": y.ravel(), "x": x.ravel(), "v": img.ravel().astype(float)}))
    return spark.createDataFrame(pd.concat(rows)).repartition(4)


def test_pieces_cover_each_tile_and_its_halo(spark):
    img = np.random.default_rng(1).random((70, 53))
    px = table(spark, {"a": img, "b": img[:9, :5]})
    parts = tiles.blocks(px, 16).join(tiles.ends(px), "image")

    def check(pdf):
        got, y, x = tiles.put_together(pdf)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "ty": [pdf["ty"].iloc[0]], "tx": [pdf["tx"].iloc[0]], "y": [y], "x": [x], "h": [got.shape[0]], "w": [got.shape[1]], "data": [got.tobytes()]})

    for side, halo in ((16, 4), (20, 30), (100, 8)):
        found = tiles.on_tiles(parts, check, "image string, ty long, tx long, y long, x long, h int, w int, data binary", side, halo).collect()
        assert len(found) == -(-70 // side) * -(-53 // side) + 1
        for r in found:
            whole = img if r.image == "a" else img[:9, :5]
            y, x = max(0, r.ty * side - halo), max(0, r.tx * side - halo)
            assert (r.y, r.x) == (y, x)
            wanted = whole[y: (r.ty + 1) * side + halo, x: (r.tx + 1) * side + halo]
            np.testing.assert_array_equal(np.frombuffer(r.data).reshape(r.h, r.w), wanted)
    with pytest.raises(ValueError):
        tiles.pieces(parts, 16, 4, "uint8")


@pytest.fixture(scope="module")
def images():
    land = scenes.terrain(400)
    return {"land": land[:310, :330], "narrow": land[:40, :200], "tiny": land[:12, :90], "flat": np.full((60, 50), 3.0)}


@pytest.mark.parametrize("side", [110, 1024])
def test_tiled_keypoints_equal_whole_images(spark, images, side):
    """Three by three tiles give the very rows of the whole image, descriptors included."""
    found = features.detect(table(spark, images), side=side).toPandas()
    for name, img in images.items():
        points, descriptors = features.keypoints(img)
        mine = found[found["image"] == name].sort_values("kp_idx")
        assert mine["kp_idx"].tolist() == list(range(len(points)))
        np.testing.assert_array_equal(mine[["x", "y", "scale", "orientation", "response"]].to_numpy(), points)
        if len(points):
            np.testing.assert_array_equal(np.stack(mine["descriptor"]), descriptors)
    assert (found["image"] == "land").sum() > 500 and not (found["image"] == "flat").any()


def test_keypoints_lie_where_the_image_moves(spark):
    """A shift by whole pixels moves keypoints inside by as much."""
    land = scenes.terrain(260)
    a, b = features.keypoints(land[:220, :220])[0], features.keypoints(land[8:228, 16:236])[0]
    first = a[(a[:, 2] < 6) & (a[:, 0] > 80) & (a[:, 1] > 80) & (a[:, 0] < 140) & (a[:, 1] < 140)]
    near = np.hypot(first[:, None, 0] - 16 - b[None, :, 0], first[:, None, 1] - 8 - b[None, :, 1]).min(1)
    assert len(first) > 20 and np.median(near) < 0.01


def test_strongest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(50)), float(rng.integers(50)), 1.0, float(rng.integers(3)), float(rng.choice([0.0101, 0.02, 0.5, 3.0])), [0.0]) for i in "ab" for _ in range(400)] + [("c", 1.0, 1.0, 1.0, 0.0, 0.3, [0.0])]
    df = spark.createDataFrame(rows, f"image string, {features.KEYPOINT}").repartition(3)
    for most in (1, 90, 5000):
        got = features.strongest(df, most).collect()
        for image in "abc":
            wanted = sorted([(-r[5], r[2], r[1], r[4]) for r in rows if r[0] == image])[:most]
            assert sorted((r.kp_idx, -r.response, r.y, r.x, r.orientation) for r in got if r.image == image) == [(k, *w) for k, w in enumerate(wanted)]


def test_nothing_to_detect(spark):
    px = spark.createDataFrame([], "image string, y long, x long, v double")
    assert features.detect(px).count() == 0
    assert features.detect(px.unionByName(spark.createDataFrame([("one", 0, 0, 5.0)], px.schema))).count() == 0


def test_no_task_sees_more_than_a_tile(spark, images):
    px = table(spark, {"land": images["land"]})
    side, halo = 64, features.reach()
    sizes = tiles.pieces(tiles.blocks(px, side).join(tiles.ends(px), "image"), side, halo).groupBy("ty", "tx").agg(F.sum(F.col("h") * F.col("w")).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= (side + 2 * halo) ** 2


def test_boxes_of_all_sizes(spark):
    """Every pair once, whatever the sizes; no box is listed in more than four cells a level; touching, empty and null boxes meet nothing."""
    from rasterloom.operators import rules

    rng = np.random.default_rng(6)

    def boxes(n, start):
        side = np.exp(rng.uniform(np.log(0.5), np.log(4000), (n, 2)))
        low = rng.uniform(-2000, 2000, (n, 2)).round(1)
        return [(start + k, "xy"[k % 2], *map(float, (low[k, 0], low[k, 1], low[k, 0] + side[k, 0], low[k, 1] + side[k, 1]))) for k in range(n)]

    a, b = boxes(150, 0), boxes(150, 1000)
    a += [(200, "x", 0.0, 0.0, 8.0, 8.0), (201, "x", 1.0, 1.0, 1.0, 5.0), (202, None, 0.0, 0.0, 9.0, 9.0), (203, "x", None, 0.0, 1.0, 1.0)]
    b += [(1200, "x", 8.0, 0.0, 16.0, 8.0), (1201, "x", 4.0, 4.0, 12.0, 12.0), (1202, None, 0.0, 0.0, 9.0, 9.0), (1203, "x", 5.0, 5.0, 4.0, 6.0)]
    wanted = {}
    for i, c, *p in a:
        for j, d, *q in b:
            if c is not None and c == d and None not in p and p[2] > p[0] and p[3] > p[1] and q[2] > q[0] and q[3] > q[1]:
                box = (max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]))
                if box[2] > box[0] and box[3] > box[1]:
                    wanted[(i, j)] = box
    kinds = "id long, crs string, left double, bottom double, right double, top double"
    for cell in (1.0, 7.0, 5000.0):
        got = rules.overlap(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), cell).collect()
        assert len(got) == len(wanted) and {(r.a_id, r.b_id): (r.left, r.bottom, r.right, r.top) for r in got} == wanted
    whole = spark.createDataFrame(a[:150], kinds).withColumn("level", rules._level(1.0))
    each = rules.listed(whole, 1.0, F.sequence(F.col("level"), F.lit(14))).groupBy("id", "at").count()
    assert each.agg(F.max("count")).first()[0] <= 4
    assert rules.overlap(spark.createDataFrame([], kinds), spark.createDataFrame(b, kinds), 1.0).count() == 0


def test_crowded_cell_meets_in_many_tasks(spark, monkeypatch):
    """Large boxes that nearly all others lie in: every pair once, no task has much more than its share, and boxes of one size are listed for one part only."""
    from rasterloom.operators import rules

    for name, value in (("TASK_PAIRS", 1 << 10), ("BLOCK_PAIRS", 1 << 10), ("BLOCK_BOXES", 1 << 6)):
        monkeypatch.setattr(rules, name, value, raising=False)
    kinds = "id long, crs string, left double, bottom double, right double, top double"
    rng = np.random.default_rng(8)
    low = rng.integers(0, 200, (900, 2)).astype(float)
    boxes = [(k, "x", x, y, *((x + 250, y + 200) if k % 100 < 2 else (x + 1 + k % 3, y + 2))) for k, (x, y) in enumerate(low.tolist())]
    df = spark.createDataFrame(boxes, kinds)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = df.withColumn("crs", F.length("crs"))  # names of systems are of any type
        got = rules.overlap(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 2.0).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = {(p[0], q[0]) for p in boxes[::2] for q in boxes[1::2] if min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    assert len(got) == len(wanted) > 1000 and set(zip(got["a_id"], got["b_id"])) == wanted
    assert got["task"].nunique() > 5 and got.groupby("task").size().max() < len(wanted) / 3
    for level, others, at_home, visits in ((2, [2], 0, [(2, 0)]), (2, [2], 1, [(2, 0)]), (2, [1, 3], 0, [(2, 0), (3, 1)]), (2, [1, 3], 1, [(2, 1), (3, 0)]), (2, [3], 0, [(3, 1)]), (2, [1], 1, [(2, 1)]), (2, [], 0, [])):
        col = rules._visits(F.lit(level), F.array(*map(F.lit, others)).cast("array<int>"), at_home)
        assert [tuple(v) for v in spark.range(1).select(col).first()[0]] == visits


def test_equal_boxes_meet_once(spark, monkeypatch):
    """Copies of boxes give every pair of ids, null ids too, but are compared as one, cut where they are many; the pairs of two boxes come out one after the other, those of one b together."""
    from rasterloom.operators import rules

    monkeypatch.setattr(rules, "BUNDLE", 16, raising=False)
    kinds = "id long, crs string, left double, bottom double, right double, top double"
    places = [(0.0, 0.0, 6.0, 5.0), (3.0, 2.0, 9.0, 9.0), (5.0, 4.0, 7.0, 12.0)]
    box = lambda k: (None if k == 7 else k, "x", *places[k % 3])
    rows = [box(k) for k in range(120)]
    a, b = (spark.createDataFrame(r, kinds).repartition(3, "id") for r in (rows, [(r[0] if r[0] is None else r[0] + 1000, *r[1:]) for r in rows]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rules.overlap(a, b, 40.0).collect()
        bundles = rules._bundles(a.repartition(2, "crs"), ["crs"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(len(r.ids) for r in bundles) == [8, 8, 8, 16, 16, 16, 16, 16, 16]
    meets = lambda p, q: (max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]))
    wanted = {(p[0], q[0] if q[0] is None else q[0] + 1000): meets(p[2:], q[2:]) for p in rows for q in rows}
    assert all(w[2] > w[0] and w[3] > w[1] for w in wanted.values())
    assert len(got) == len(wanted) == 14400 and {(r.a_id, r.b_id): (r.left, r.bottom, r.right, r.top) for r in got} == wanted
    changes = lambda key: sum(key(p) != key(q) for p, q in zip(got, got[1:]))
    assert changes(lambda r: (r.left, r.bottom, r.right, r.top)) < 81 and changes(lambda r: r.b_id) < 9 * 120


def test_patches_hold_one_block_a_task(spark, images):
    """What tiles see is cut where a block is made, so no batch of blocks passes through a task's Python; tiles put the same together."""
    from rasterloom.operators import images as operators

    px = table(spark, {"land": images["land"]})
    got = tiles.seen(px, 64, 9).toPandas()
    for (ty, tx), tile in got.groupby(["ty", "tx"]):
        if ty * 64 < 310 and tx * 64 < 330:
            y, x = max(0, ty * 64 - 9), max(0, tx * 64 - 9)
            mine, *at = tiles.put_together(tile)
            assert at == [y, x]
            np.testing.assert_array_equal(mine, images["land"][y: (ty + 1) * 64 + 9, x: (tx + 1) * 64 + 9])
    assert got.groupby(["ty", "tx"]).ngroups >= 5 * 6
    at = spark.createDataFrame([("land", k, 20 + 14 * k, 20 + 13 * k) for k in range(20)], "image string, idx long, x long, y long")
    patches = operators._patches(px, at, "x", "y", 7, "p")
    for r in patches.collect():
        x, y = 20 + 14 * r.idx, 20 + 13 * r.idx
        np.testing.assert_array_equal(np.frombuffer(r.p).reshape(15, 15), images["land"][y - 7: y + 8, x - 7: x + 8])
    assert patches.count() == 20
    assert "MapIn" not in patches._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", ["a", "b"])
def test_pairs_of_a_small_box_come_out_together(spark, large):
    """Large boxes meet many small ones, whichever side they are on: the common box and the small box's id stay the same from row to row."""
    from rasterloom.operators import rules

    small = [(k, "x", float(k % 30), float(k // 30), float(k % 30) + 1, float(k // 30) + 1) for k in range(600)]
    wide = [(1000 + k, "x", -1.0 - k / 64, -1.0, 60.0, 60.0) for k in range(40)]
    a, b = (spark.createDataFrame(rows, "id long, crs string, left double, bottom double, right double, top double") for rows in ((wide, small) if large == "a" else (small, wide)))
    got = rules.overlap(a, b, 1.0).collect()
    assert {(r.a_id, r.b_id) for r in got} == {(x[0], y[0]) if large == "a" else (y[0], x[0]) for x in wide for y in small} and len(got) == 24_000
    of = [(r.b_id if large == "a" else r.a_id, *r[2:]) for r in got]
    assert sum(x != y for x, y in zip(of, of[1:])) < 2 * 600
