import math

import numpy as np
import pytest

from factloom.llm import hard_negatives


def plain(rows):
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, y, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i)
            for s, j, _ in [x for x in scored if x[2] == y][:5]:
                found = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
                out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(found, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, **kw).collect())


SCHEMA = "vec_id long, label int, embedding array<float>, rank int, score string"


@pytest.mark.parametrize("sizes", [{}, {"group": 3, "tile": 16, "leaf": 2}])
def test_against_all_scores(spark, sizes):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((700, 9)) + 0.4, 1).astype(np.float32)  # few values, so many ties
    rows = [(i, int(rng.integers(0, 10) if i % 3 else 4), v.tolist()) for i, v in enumerate(x)]
    rows += [(750, 4, None), (800, None, [1.0] * 9), (850, 4, [None] * 9), (900, 4, [float("nan")] * 9), (950, 4, [float("inf")] * 9), (None, 4, [1.0] * 9), (1000, 4, [1.0] * 4), (1001, 5, [])]
    rows += rows[51:90]  # repeated rows
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(6)
    want = plain(rows)
    assert len(want) > 50 and mined(df, **sizes) == want


def test_repeated_anchors_few_rows_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 2, [0.9, 0.0]), (5, 2, [0.6, 0.5]), (6, 2, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert mined(df) == plain(rows)
    assert mined(df.where("vec_id > 0")) == [] and mined(df.limit(0)) == []


def test_too_large_components_are_told(spark):
    df = spark.createDataFrame([(0, 1, [1e15], 0, ""), (1, 1, [1e15], 0, "")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        mined(df)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (33, 64, 17), (40, 33, 50)])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_strassen_is_exact(shape, leaf):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 40), 1 << 40, (m, k)), rng.integers(-(1 << 15), 1 << 15, (k, n))
    assert (hard_negatives.strassen(a, b, leaf) == (a.astype(object) @ b.astype(object)).astype(np.int64)).all()


@pytest.mark.parametrize("scale", [1, 3, 9, 40, 1 << 12, 1 << 16, 1 << 19])
def test_products_are_exact_in_the_type_that_is_chosen(scale):
    # lengths around what 24 and 53 bits hold; rows that add up, so sums on the way are as large as they can be
    rng = np.random.default_rng(scale)
    for width in (5, 64, 130):
        a = rng.integers(200 * scale, 256 * scale + 1, (90, width)) // int(width**0.5) * rng.choice([-1, 1], (1, width))
        b = np.where(rng.random((70, width)) < 0.5, a[:70], -a[:70])
        x, y = (hard_negatives.Tile(np.arange(len(v)), np.zeros(len(v), np.int64), v) for v in (a, b))
        p, q, side = x.against(y, 4)
        assert p.dtype == q.dtype and (p.dtype != np.int64 or scale >= 1 << 16)  # all were 64-bit integers, multiplied without a library
        assert (hard_negatives.strassen(p, q, side).astype(np.int64) == a @ b.T).all()


def test_heaps_keep_the_best_by_few_and_by_many_hits():
    rng = np.random.default_rng(4)
    ids, labels = rng.permutation(3000), rng.integers(0, 3, 3000)
    x = rng.integers(-30, 60, (3000, 6))
    for alike in (True, False):
        tile = hard_negatives.Tile(ids[:40], np.sort(labels[:40]), x[:40])
        low, high = (np.full((1, 40), -(1 << 62)), np.full((1, 40), 1 << 58)) if alike else (rng.integers(0, 3000, (2, 40)), rng.integers(3000, 9000, (2, 40)))
        g = hard_negatives.Group(tile, low, high, 3)
        for first in range(0, 3000, 250):
            some = slice(first, first + 250)
            other = hard_negatives.Tile(ids[some], labels[some], x[some])
            p, q, side = g.against(other, 2)
            g.offer(0, hard_negatives.strassen(p[:40], q, side), hard_negatives.Tile(ids[some], labels[some] if not alike else np.zeros(250, np.int64), x[some]), slice(0, 250), alike)
        for w, h in enumerate(g.heaps):
            place, who, score = h.rows()
            for i in range(40):
                s = x @ x[i]
                fit = ids != ids[i] if alike else (labels != tile.labels[i]) & (s >= low[w, i]) & (s <= high[w, i])
                want = sorted((-int(v), int(j)) for v, j in zip(s[fit], ids[fit]))[:3]
                assert [(-int(v), int(j)) for v, j in zip(score[place == i], who[place == i])] == want


def test_cells_have_their_share_of_tiles_and_all_groups(spark):
    # groups and parts meet once each, whatever task a group comes to, and no task gets most of the tiles
    rows = [(i, i % 3, [1.0, float(i % 7)]) for i in range(4000)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(4)
    usable = hard_negatives.usable(df)
    tiles = hard_negatives.common.written(hard_negatives.packed(usable, 16), "t")
    groups = hard_negatives.common.written(hard_negatives.packed(usable.where("vec_id % 50 = 0").repartition(20), None).withColumn("group", hard_negatives.F.spark_partition_id()), "g")
    cells: dict = {}
    for r in hard_negatives._met(tiles, groups, 20).select("cell", "group", "ids", hard_negatives.F.spark_partition_id().alias("task")).collect():
        cells.setdefault((r.cell, r.task), ([], []))[r.group is None].append(r.group if r.group is not None else len(r.ids))
    assert len({c for c, _ in cells}) == len({t for _, t in cells}) == len(cells)
    total = sum(sum(n) * len(g) for g, n in cells.values())
    assert total == 4000 * groups.count()
    assert max(len(n) for _, n in cells.values()) <= 3 * tiles.count() * 3 / len(cells)
