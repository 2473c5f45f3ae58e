"""Local image descriptors: cropped and edited copies among media columns.

Corners of several scales get an orientation from their patch's centroid and a binary descriptor of brightness tests
turned by it. Descriptors meet in six Hamming tables, each keyed by 24 of their bits. A task compares the members of a
bucket on all bits and sends on the near ones of different images only; a bucket of very many is dealt by further bits
first, over tasks and then within one. Near descriptors of two images vote for the shift, turn and scale between them,
and enough votes for one such change link the images.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard

SIDE = 64
SCALES = (1.0, 0.75)
#: Pixels a corner of one scale stands for: larger pictures have more.
CORNER_PIXELS = 205
RADIUS = 12
#: Hamming tables, bits of their keys, members of a bucket compared at once, members beyond which one is met in parts,
#: corners a block has and a task holds (once a table), about.
TABLES, KEY_BITS, MEMBERS, HOT, BLOCK, HELD = 8, 24, 1 << 10, 1 << 14, 1 << 17, 1 << 19
#: Bits of 256 in which matching descriptors may differ, matches of one change that link, and cell sizes of votes.
NEAR, VOTES, SHIFT = 24, 4, 8.0


@lru_cache(1)
def _tests() -> np.ndarray:
    """Pairs of points whose brightness is compared. They lie across the patch's own direction, as brightness along it
    differs in the same sense in every patch, which would tell nothing."""
    points = np.random.default_rng(3).uniform(-RADIUS + 1, RADIUS - 1, (2, 200_000, 2))
    along, across = np.abs(points[0] - points[1]).T
    good = (along <= 2) & (across >= 2) & (across <= 6) & ((points**2).sum(2) <= RADIUS**2).all(0)
    return points[:, good][:, :256]


def _box(x: np.ndarray, r: int) -> np.ndarray:
    total = np.pad(np.pad(x, r, "edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / (n * n)


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = int(x.shape[0] * scale), int(x.shape[1] * scale)
    r, c = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    r0, c0 = np.clip(r.astype(int), 0, x.shape[0] - 2), np.clip(c.astype(int), 0, x.shape[1] - 2)
    fr, fc = np.clip(r - r0, 0, 1)[:, None], np.clip(c - c0, 0, 1)
    top, low = x[r0], x[r0 + 1]
    return (top[:, c0] * (1 - fc) + top[:, c0 + 1] * fc) * (1 - fr) + (low[:, c0] * (1 - fc) + low[:, c0 + 1] * fc) * fr


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, scale, angle) in the image's own pixels, and descriptors as 256 booleans, of its corners."""
    places, bits = [], []
    tests = _tests()
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    inside = xx**2 + yy**2 <= RADIUS**2
    for scale in SCALES:
        x = _box(image.astype(np.float64) if scale == 1 else _resized(image.astype(np.float64), scale), 1)
        if min(x.shape) <= 2 * RADIUS + 4:
            continue
        gy, gx = np.gradient(x)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        middle = corner[1:-1, 1:-1]
        peak = np.ones(middle.shape, bool)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    peak &= middle > corner[dy : dy + middle.shape[0], dx : dx + middle.shape[1]]
        ys, xs = np.nonzero(peak & (middle > 1e-3))
        ys, xs = ys + 1, xs + 1
        ok = (ys > RADIUS) & (ys < x.shape[0] - RADIUS - 1) & (xs > RADIUS) & (xs < x.shape[1] - RADIUS - 1)
        ys, xs = ys[ok], xs[ok]
        top = np.argsort(-corner[ys, xs], kind="stable")[: max(20, image.size // CORNER_PIXELS)]
        ys, xs = ys[top], xs[top]
        if not len(ys):
            continue
        patch = x[ys[:, None, None] + yy, xs[:, None, None] + xx] * inside
        angle = np.arctan2((patch * yy).sum((1, 2)), (patch * xx).sum((1, 2)))
        co, si = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = []
        for p in tests:
            px, py = np.rint(co * p[:, 0] - si * p[:, 1]).astype(int), np.rint(si * p[:, 0] + co * p[:, 1]).astype(int)
            value.append(x[np.clip(ys[:, None] + py, 0, x.shape[0] - 1), np.clip(xs[:, None] + px, 0, x.shape[1] - 1)])
        bits.append(value[0] < value[1])
        places.append(np.stack([(xs + 0.5) / scale, (ys + 0.5) / scale, np.full(len(xs), 1 / scale), angle], 1))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, 256), bool)
    return np.concatenate(places), np.concatenate(bits)


def descriptors(media: DataFrame) -> DataFrame:
    """(id, kp, x, y, scale, angle, d0..d3): a row for each corner of each (id, width, height, image) with 8-bit grey
    pixels; images that are null or not of their size have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, geometry, found = [], [], []
            for i, w, h, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if i is None or raw is None or w is None or h is None or len(raw) != w * h or not raw:
                    continue
                place, bit = describe(np.frombuffer(raw, np.uint8).reshape(h, w))
                ids += [(i, k) for k in range(len(bit))]
                geometry.append(place)
                found.append(bit)
            if ids:
                owner, kp = (np.array(x, np.int64) for x in zip(*ids))
                packed = np.packbits(np.concatenate(found), axis=1).view(">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (owner, kp, *np.concatenate(geometry).T.astype(np.float32), *packed.T)], ["id", "kp", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3"])

    return media.select("id", "width", "height", "image").mapInArrow(run, "id long, kp long, x float, y float, scale float, angle float, d0 long, d1 long, d2 long, d3 long")


@lru_cache(1)
def _key_bits() -> np.ndarray:
    """The bits of each table's key."""
    rng = np.random.default_rng(17)
    return np.stack([rng.permutation(256) for _ in range(TABLES)])[:, :KEY_BITS]


def _bits(words_: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The bits ``which`` of descriptors (rows of four 64-bit words), as one number each."""
    out = np.zeros(len(words_), np.uint64)
    for bit in which.tolist():
        out = (out << np.uint64(1)) | ((words_[:, bit >> 6] >> np.uint64(63 - (bit & 63))) & np.uint64(1))
    return out


def _near(d: np.ndarray, owner: np.ndarray, members: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of near descriptors of different images among the members of a bucket. Each is compared with every
    other, ``members`` by ``members`` of them at a time."""
    for x in range(0, len(d), members):
        for y in range(x, len(d), members):
            left, right = d[x : x + members], d[y : y + members]
            differ = sum(np.bitwise_count(left[:, None, k] ^ right[None, :, k]).astype(np.int16) for k in range(4))
            good = (differ <= NEAR) & (owner[x : x + members, None] != owner[None, y : y + members])
            i, j = np.nonzero(np.triu(good, 1) if x == y else good)
            if len(i):
                yield i + x, j + y


def _cells(part: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, cell) for entries in ``part`` of so many ``parts`` of their bucket: a cell is a pair of parts, and an entry
    goes to all cells of its part, so that every two entries meet in one."""
    entry = np.repeat(np.arange(len(part)), parts)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = part[entry]
    return entry, np.minimum(own, other) * parts[entry] + np.maximum(own, other)


_PACKED = {"shard": pa.int32(), "tables": pa.binary(), "corners": pa.binary(), "ids": pa.binary()}
_CORNER = np.dtype([("d", "<u8", 4), ("id", "<u4"), ("kp", "<u4"), ("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4")])


def _pairs(marks: DataFrame, n: int, members: int = MEMBERS, hot_members: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b, m) of two images, with the near descriptors {ka, kb, r, t, tx, ty} that a task found of them and the change
    from the smaller id to the larger that each stands for. A pair may come from several tasks, and from several cells of
    a bucket that has more than ``hot_members`` members and is met in parts."""
    spark = marks.sparkSession
    shards = max(common.shards(spark), n * TABLES // HELD)
    columns = ["id", "kp", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3"]

    def keys(d: np.ndarray) -> np.ndarray:
        return np.stack([_bits(d, own) | np.uint64(t << KEY_BITS) for t, own in enumerate(_key_bits())], 1)

    def descriptors_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in range(batch.num_columns - 4, batch.num_columns)], 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c = np.unique(keys(descriptors_of(batch)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(c)], ["key", "n"])

    most = max(hot_members, n * TABLES // 10_000)  # so there are ten thousand hot buckets at most
    hot_keys, hot_parts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > most:
        rows = marks.select(*columns[6:]).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n > {most}")
        found = sorted((r["key"], r["n"]) for r in rows.collect())
        hot_keys, hot_parts = np.array([k for k, _ in found], np.uint64), np.array([-(-c // most) for _, c in found], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            corner, d = np.zeros(part.num_rows, _CORNER), descriptors_of(part)
            ids, corner["id"] = np.unique(part.column(0).to_numpy(), return_inverse=True)
            for k, c in enumerate(columns[1:6], 1):
                corner[c] = part.column(k).to_numpy()
            corner["d"] = d
            key = keys(d)
            row, table = np.divmod(np.arange(key.size), TABLES)
            key = key.ravel()
            place = jaccard.words.mix(key)
            at = np.searchsorted(hot_keys, key)
            is_hot = np.flatnonzero(hot_keys[np.minimum(at, len(hot_keys) - 1)] == key) if len(hot_keys) else at[:0]
            if len(is_hot):
                parts = hot_parts[at[is_hot]]
                # by image and corner, so that each table deals a corner alike wherever it is sent from
                mine = jaccard.words.mix(ids[corner["id"]].astype(np.uint64) * np.uint64(1 << 20) + corner["kp"])[row[is_hot]] % parts.astype(np.uint64)
                entry, cell = _cells(mine.astype(np.int64), parts)
                entry = is_hot[entry]
                keep = np.ones(len(key), bool)
                keep[is_hot] = False
                row, table = np.concatenate([row[keep], row[entry]]), np.concatenate([table[keep], table[entry]])
                place = np.concatenate([place[keep], jaccard.words.mix(key[entry] * np.uint64(31) + cell.astype(np.uint64))])
            shard = (place % np.uint64(shards)).astype(np.int64)
            # which tables send each corner to each shard, as bits
            where, which = np.unique(shard * part.num_rows + row, return_inverse=True)
            bits = np.zeros(len(where), np.uint8)
            np.bitwise_or.at(bits, which, (1 << table).astype(np.uint8))
            rows = []
            for own in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where // part.num_rows)) + 1):
                packed = corner[where[own] % part.num_rows]
                present, packed["id"] = np.unique(packed["id"], return_inverse=True)
                rows.append((int(where[own[0]] // part.num_rows), bits[own].tobytes(), packed.tobytes(), ids[present].tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.values())], list(_PACKED))

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= block:
                yield flush()
                size = 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        tables = np.concatenate([np.frombuffer(x, np.uint8) for x in table["tables"].to_pylist()])
        corner = [np.frombuffer(x, _CORNER) for x in table["corners"].to_pylist()]
        owner = np.concatenate([np.frombuffer(i, np.int64)[c["id"]] for i, c in zip(table["ids"].to_pylist(), corner)])
        corner = np.concatenate(corner)
        d, found = np.ascontiguousarray(corner["d"]), []
        for t in range(TABLES):
            own = np.flatnonzero(tables >> t & 1)
            key = _bits(d[own], _key_bits()[t])
            own = own[np.argsort(key, kind="stable")]
            key = np.sort(key)
            for bucket in np.split(own, np.flatnonzero(np.diff(key)) + 1):
                if len(bucket) > 1:
                    found += [(bucket[i], bucket[j]) for i, j in _near(d[bucket], owner[bucket], members)]
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        i, j = np.where(owner[i] < owner[j], i, j), np.where(owner[i] < owner[j], j, i)
        if len(i):
            _, pick = np.unique(i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64), return_index=True)
            i, j = i[pick], j[pick]
        order = np.lexsort((owner[j], owner[i]))
        i, j = i[order], j[order]
        a, b = corner[i], corner[j]
        ratio, turn = b["scale"] / a["scale"], b["angle"] - a["angle"]
        tx = b["x"] - ratio * (np.cos(turn) * a["x"] - np.sin(turn) * a["y"])
        ty = b["y"] - ratio * (np.sin(turn) * a["x"] + np.cos(turn) * a["y"])
        found = [a["kp"].astype(np.int32), b["kp"].astype(np.int32), *(x.astype(np.float32) for x in (np.log2(ratio), turn, tx, ty))]
        # one row for all that two images have in common here
        new = np.flatnonzero(np.diff(owner[i], prepend=-1) | np.diff(owner[j], prepend=-1)) if len(i) else np.zeros(0, np.int64)
        common_ = pa.StructArray.from_arrays([pa.array(x) for x in found], ["ka", "kb", "r", "t", "tx", "ty"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(i)).astype(np.int32)), common_)
        return pa.table([pa.array(owner[i][new]), pa.array(owner[j][new]), lists], ["a", "b", "m"])

    sent = marks.select(*columns).mapInArrow(send, "shard int, tables binary, corners binary, ids binary")
    return sent.groupBy("shard").applyInArrow(meet, "a long, b long, m array<struct<ka:int,kb:int,r:float,t:float,tx:float,ty:float>>")


def copies(media: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of each row of ``media`` (id, width, height, image): images link when they are equal or
    one is a cropped, turned, rescaled or otherwise edited copy; class_id is the smallest id reachable, n_links counts
    the other images that an image's representative was linked to directly.

    Equal images are one from the start, so copies are not compared. Null images stand alone; repeated rows are equal
    images; rows without an id are left out; an empty table gives an empty result; other columns are not looked at.
    """
    rows = common.written(media.where("id is not null").select("id", "width", "height", "image"), "media")
    hashed = rows.select("id", F.when(F.col("image").isNotNull(), F.sha2(F.concat_ws("x", "width", "height", F.hex("image")), 256)).alias("sha"))
    hashed = common.written(hashed, "images")
    first = hashed.where("sha is not null").groupBy("sha").agg(F.min("id").alias("rep"))
    unique = rows.join(first.select(F.col("rep").alias("id")), "id", "left_semi")
    marks = common.written(descriptors(unique), "descriptors")
    met = _pairs(marks, marks.count())
    # two images need VOTES corners in common at least, so others need no geometry
    pair = F.array_distinct(F.flatten(F.collect_list("m")))
    enough = met.groupBy("a", "b").agg(pair.alias("m")).where(F.size("m") >= VOTES)
    votes = enough.select("a", "b", F.explode("m").alias("v")).select("a", "b", "v.*", F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("o"))
    cells = votes.select(
        "a", "b", "ka", "kb", F.round("r", 1).alias("r"), F.pmod(F.floor(F.col("t") / F.lit(np.pi / 6) + F.col("o")), F.lit(12)).alias("t"),
        F.floor(F.col("tx") / SHIFT + F.col("o")).alias("u"), F.floor(F.col("ty") / SHIFT + F.col("o")).alias("v"), "o")
    agreed = cells.groupBy("a", "b", "r", "t", "u", "v", "o").agg(F.count_distinct("ka").alias("n"), F.count_distinct("kb").alias("m")).where(f"least(n, m) >= {VOTES}")
    links = common.written(agreed.select("a", "b").distinct(), "links")
    classes = common.written(jaccard.components(links), "classes")
    degree = links.select("a").union(links.select("b")).groupBy("a").count()
    named = first.join(classes, first.rep == classes.node, "left").join(degree, first.rep == degree.a, "left").select(F.col("sha").alias("__sha"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("count", F.lit(0)).alias("n_links"))
    return hashed.join(named, hashed.sha == F.col("__sha"), "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def render(seed: bytes, side: int = SIDE) -> np.ndarray:
    """A texture that the seed alone determines."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed).digest()[:8], "big"))
    image = np.zeros((side, side))
    for cell in (16, 8, 4):
        grid = rng.uniform(-1, 1, (side // cell + 1, side // cell + 1))
        image += cell**0.5 * _resized(grid, cell)[:side, :side]
    low, high = image.min(), image.max()
    return ((image - low) / (high - low) * 255).astype(np.uint8)


def edit(image: np.ndarray, number: int) -> np.ndarray:
    """A copy cropped by up to a seventh at each side, brightened or darkened, and given noise, as ``number`` says."""
    rng = np.random.default_rng(number)
    t, b, l, r = rng.integers(0, image.shape[0] // 7, 4)
    out = image[t : image.shape[0] - b, l : image.shape[1] - r].astype(np.float64)
    out = out * rng.uniform(0.75, 1.1) + rng.uniform(-10, 10) + rng.normal(0, 2, out.shape)
    return np.clip(out, 0, 255).astype(np.uint8)


def media_of(vectors: DataFrame) -> DataFrame:
    """A media table (id, width, height, image) of an embeddings table: each vector's texture, and for ids that leave 3
    divided by 10 an edited copy of the picture of the id before."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").alias("id"), F.to_json(F.col("embedding")).cast("binary").alias("seed"))
    own = rows.where("pmod(id, 10) <> 3").withColumn("edited", F.lit(False))
    before = rows.where("pmod(id, 10) = 2").select((F.col("id") + 1).alias("id"), "seed")
    other = rows.where("pmod(id, 10) = 3").select("id").join(before, "id").withColumn("edited", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pictures = []
                for i, seed, edited in zip(*(c.to_pylist() for c in part.columns)):
                    picture = render(seed or b"")
                    pictures.append(edit(picture, i) if edited else picture)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([p.shape[1] for p in pictures], pa.int32()), pa.array([p.shape[0] for p in pictures], pa.int32()), pa.array([p.tobytes() for p in pictures], pa.binary())],
                    ["id", "width", "height", "image"])

    return own.unionByName(other).mapInArrow(run, "id long, width int, height int, image binary")
