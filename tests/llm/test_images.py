import numpy as np
import pytest

from factloom.llm import images


def test_copies_are_found_and_others_left_alone(spark):
    rows = []
    for i in range(60):
        picture = images.render(str(i).encode())
        rows.append((i, 64, 64, picture.tobytes()))
        if i % 3 == 0:
            e = images.edit(picture, i)
            rows.append((100 + i, e.shape[1], e.shape[0], e.tobytes()))
    rows += [(500, 64, 64, rows[0][3]), (501, 64, 64, None), (502, 3, 3, b"123"), (503, 64, 64, bytes(4096)), rows[1], (None, 64, 64, rows[0][3])]
    got = {r.id: r for r in images.copies(spark.createDataFrame(rows, "id long, width int, height int, image binary")).collect()}
    found = [got[100 + i].class_id == i for i in range(0, 60, 3)]
    assert np.mean(found) >= 0.9 and got[500].class_id == 0
    assert all(got[i].class_id == i for i in range(60)) and all(got[i].class_id == i for i in (501, 502, 503))
    assert images.copies(spark.createDataFrame([], "id long, width int, height int, image binary")).count() == 0


def media(spark, pictures):
    return spark.createDataFrame([(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in pictures.items()], "id long, width int, height int, image binary")


def test_turned_and_rescaled_copies(spark):
    base = {i: images.render(str(i).encode()) for i in range(60)}
    turned = {100 + i: np.ascontiguousarray(np.rot90(p)) for i, p in base.items() if i < 20}
    scaled = {200 + i: np.rint(images._resized(p.astype(float), 0.75)).astype(np.uint8) for i, p in base.items() if 20 <= i < 40}
    got = {r.id: r.class_id for r in images.copies(media(spark, base | turned | scaled)).collect()}
    assert np.mean([got[i] == i - 100 for i in turned]) >= 0.9 and np.mean([got[i] == i - 200 for i in scaled]) >= 0.9
    assert all(got[i] == i for i in base)


def with_logo(n, side, at, pictures):
    """Pictures with one logo of 40 pixels and noise."""
    rng, logo, out = np.random.default_rng(1), images.render(b"logo", 40), {}
    for i in range(n):
        p = images.render(str(i % pictures).encode(), side).copy()
        p[at : at + 40, at : at + 40] = logo
        out[i] = np.clip(p + rng.normal(0, 2, p.shape), 0, 255).astype(np.uint8)
    return out


def near_pairs(rows):
    """Of different images, by comparing all descriptors."""
    d = np.array([[r.d0, r.d1, r.d2, r.d3] for r in rows], np.int64).view(np.uint64)
    near = set()
    for x in range(0, len(rows), 500):
        differ = sum(np.bitwise_count(d[x : x + 500, None, k] ^ d[None, :, k]).astype(int) for k in range(4))
        for i, j in zip(*(v.tolist() for v in np.nonzero(differ <= images.NEAR))):
            if rows[x + i].id < rows[j].id:
                near.add(((rows[x + i].id, rows[x + i].kp), (rows[j].id, rows[j].kp)))
    return near


@pytest.mark.parametrize("limits", [{}, {"members": 7, "hot_members": 5, "block": 300}, {"members": 1000, "hot_members": 20}])
def test_near_descriptors_are_met_in_full_buckets_too(spark, limits):
    """Against a plain comparison of all descriptors; a logo in every picture fills buckets."""
    marks = images.descriptors(media(spark, with_logo(40, 96, 50, 30))).cache()
    rows = marks.collect()
    near = near_pairs(rows)
    got = {((r.a, x.ka), (r.b, x.kb)) for r in images._pairs(marks, len(rows), **limits).collect() for x in r.m}
    plain = {((r.a, x.ka), (r.b, x.kb)) for r in images._pairs(marks, len(rows)).collect() for x in r.m} if limits else got
    assert got == plain and got <= near and len(got) >= 0.9 * len(near)


def test_links_of_many_pictures_with_one_logo(spark):
    pictures = with_logo(150, 64, 12, 150)
    marks = images.descriptors(media(spark, pictures)).cache()
    near = near_pairs(marks.collect())
    corners = {}
    for (a, ka), (b, kb) in near:
        corners.setdefault((a, b), []).append((ka, kb))
    able = sum(len({x for x, _ in c}) >= images.VOTES and len({y for _, y in c}) >= images.VOTES for c in corners.values())
    got = images.copies(media(spark, pictures)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.n_links for r in got) / 2 >= 0.9 * able * 0.95  # not all that could vote agree


def test_every_two_parts_of_a_bucket_share_a_cell():
    part, parts = np.array([0, 1, 2, 0, 3]), np.array([4, 4, 4, 4, 4])
    entry, cell = images._cells(part, parts)
    mine = {i: set(cell[entry == i].tolist()) for i in range(5)}
    assert all(mine[i] & mine[j] for i in range(5) for j in range(5)) and all(len(m) == 4 for m in mine.values())
