"""Hard negatives by inner products of integer tiles, multiplied by Strassen's recursion.

Rows are packed into tiles of integers, sorted by label, anchors into groups of tiles' size times some; each candidate tile
meets each group once a round, in cells of (some groups, part of the tiles) that are tasks. In the first round a task keeps,
for each anchor, a heap of the best rows of its label, and only runs of one label are multiplied; heaps of tasks merge in
Spark to the positives. In the second one it keeps a heap for each anchor and positive, of rows of other labels whose score
lies in the positive's window, and these merge likewise. Scores are 64-bit integers; tiles are multiplied in floating point
where no sum on the way can reach what that holds exactly, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a tile, anchors of a group, anchors whose products with a tile are made at once (as a core's cache holds), and the
#: side below which tiles are multiplied directly.
TILE, GROUP, ANCHORS, LEAF = 1024, 1 << 14, 512, 16
#: Groups whose heaps a task holds, tiles (and bytes) whose rows are sorted by label together, and what a score stays below.
HELD, SORTED, SORTED_BYTES, LARGEST = 8, 64, 1 << 26, 1 << 58
_NONE = -(1 << 62)
_TILE = "ids array<long>, labels array<long>, components binary, width int, kind string, dealt double"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("components", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("dealt", pa.float64())])


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of any shape and one type: halved on all three sides, with a row or column of zeros where
    one is odd, as seven products of halves."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), a.dtype)
    c11, c12, c21, c22 = out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    np.subtract(p1, p5, out=c11)
    p3 = strassen(a11, b12 - b22, leaf)
    np.add(p3, p5, out=c12)
    np.add(p1, p3, out=c22)
    p2 = strassen(a21 + a22, b11, leaf)
    c22 -= p2
    p4 = strassen(a22, b21 - b11, leaf)
    np.add(p2, p4, out=c21)
    c11 += p4
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]


def _kind(a: float, b: float, width: int, leaf: int) -> type:
    """In what rows of lengths ``a`` and ``b`` at most are multiplied exactly by ``strassen``. A halving adds up two halves
    of each at most, so products grow fourfold; the last sums are of four products, of twelve times a b of their level."""
    depth = 0
    while width > leaf:
        width, depth = (width + 1) // 2, depth + 1
    most = 1.01 * (a + 1) * (b + 1) * (12 * 4.0 ** (depth - 1) if depth else 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Heaps:
    """For each of ``n`` places the best ``k`` (score, id), by score from the top and then by id from below."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, first: int, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Take in the ``valid`` of ``scores``, whose rows are places from ``first`` on and whose columns are ``ids``."""
        n, k = len(scores), self.score.shape[1]
        mine = slice(first, first + n)
        least = self.score[mine, -1]
        hit = valid & (scores >= least[:, None])
        if scores.shape[1] > k and np.count_nonzero(hit) > 4 * k * n:
            least = np.partition(np.where(hit, scores, _NONE), -k, axis=1)[:, -k]
            hit &= scores >= least[:, None]
        row, col = np.divmod(np.flatnonzero(hit), scores.shape[1])
        self.merge(first + row, scores[row, col].astype(np.int64), ids[col])

    def merge(self, row: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """Take in (score, id) at places ``row``."""
        k = self.score.shape[1]
        if not len(row):
            return
        some = np.unique(row)
        row = np.concatenate([row, np.repeat(some, k)])
        score = np.concatenate([score, self.score[some].ravel()])
        who = np.concatenate([who, self.id[some].ravel()])
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.score[row[keep], rank[keep]], self.id[row[keep], rank[keep]] = score[keep], who[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, id and score of all that are kept."""
        place, at = np.nonzero(self.score != _NONE)
        return place, self.id[place, at], self.score[place, at]


def _tile(ids: list, labels: list, vectors: list, dealt: float = 0.0) -> dict:
    width = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x = np.floor(256 * x)
    top = np.abs(x).max(initial=0)
    if top >= LARGEST:
        raise ValueError("components are too large for exact 64-bit scores")
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return {"ids": ids, "labels": labels, "components": x.astype(kind).tobytes(), "width": width, "kind": kind, "dealt": dealt}


class Tile:
    """Ids, labels and components of a tile or group, whose rows are sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.top, self.length = int(np.abs(x).max(initial=0)), float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))
        self._as: dict = {}

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int) -> Tile:
        get = lambda c: batch.column(c)[row]
        ids, labels = get("ids").values.to_numpy(), get("labels").values.to_numpy()
        return cls(ids, labels, np.frombuffer(get("components").as_py(), get("kind").as_py()).reshape(len(ids), get("width").as_py()).astype(np.int64))

    def of(self, kind: type, width: int) -> np.ndarray:
        """The components in another type, followed by zeros."""
        if (kind, width) not in self._as:
            self._as[kind, width] = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1]))).astype(kind)
        return self._as[kind, width]

    def against(self, other: Tile, leaf: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Both tiles' components, the other's turned, in a type in which their products are exact, and the side of
        products made at once: a library's in floating point, where a leaf may be twice as wide."""
        width = max(self.x.shape[1], other.x.shape[1])
        if width * self.top * other.top >= LARGEST:
            raise ValueError("components are too large for exact 64-bit scores")
        kind = _kind(self.length, other.length, width, 2 * leaf)
        return self.of(kind, width), np.ascontiguousarray(other.of(kind, width).T), leaf if kind is np.int64 else 2 * leaf


class Group(Tile):
    """Anchors with a heap for each of their windows, scores from ``low`` to ``high`` (windows, anchors)."""

    def __init__(self, tile: Tile, low: np.ndarray, high: np.ndarray, keep: int):
        super().__init__(tile.ids, tile.labels, tile.x)
        self.low, self.high, self.heaps = low, high, [Heaps(len(self.ids), keep) for _ in low]
        self.floor, self.roof = low.min(0, initial=LARGEST), high.max(0, initial=_NONE)

    def offer(self, first: int, scores: np.ndarray, tile: Tile, some: slice, alike: bool) -> None:
        """Take in ``scores`` of the anchors from ``first`` on and the tile's rows ``some``: of an anchor's label but not of
        its id if ``alike``, or else of other labels."""
        mine = slice(first, first + len(scores))
        ids, labels = tile.ids[some], tile.labels[some]
        floor, roof = self.floor[mine].astype(scores.dtype), self.roof[mine].astype(scores.dtype)
        if scores.dtype != np.int64:  # rounded outwards
            floor, roof = np.nextafter(floor, scores.dtype.type(-np.inf)), np.nextafter(roof, scores.dtype.type(np.inf))
        hit = scores >= floor[:, None]
        if (n := np.count_nonzero(hit)) > scores.size // 16:
            n = np.count_nonzero(hit := hit & (scores <= roof[:, None]))
        if n > scores.size // 16:
            fit = self.ids[mine, None] != ids if alike else self.labels[mine, None] != labels
            for h, low, high in zip(self.heaps, self.low[:, mine], self.high[:, mine]):
                h.add(first, scores, fit & (scores >= low[:, None]) & (scores <= high[:, None]), ids)
        elif n:
            rows = np.flatnonzero(hit.any(1))
            row, col = np.divmod(np.flatnonzero(hit[rows]), scores.shape[1])
            row = rows[row]
            score, row = scores[row, col].astype(np.int64), first + row
            fit = self.ids[row] != ids[col] if alike else self.labels[row] != labels[col]
            row, col, score = row[fit], col[fit], score[fit]
            for h, low, high in zip(self.heaps, self.low, self.high):
                fit = (score >= np.maximum(low[row], h.score[row, -1])) & (score <= high[row])
                h.merge(row[fit], score[fit], ids[col[fit]])
        if n:
            self.floor[mine] = np.min([np.maximum(low, h.score[mine, -1]) for h, low in zip(self.heaps, self.low[:, mine])], 0)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, those of every seventh id with the next label."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"))


def packed(rows: DataFrame, size: int | None) -> DataFrame:
    """Rows in tiles of ``size``, or with None in one for each partition, sorted by label; ``dealt`` is spread from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        n_bytes, dealt = 0, TaskContext.get().partitionId() * 0.7548776662466927 % 1

        def tiles() -> Iterator[pa.RecordBatch]:
            nonlocal n_bytes, dealt
            order = np.argsort(np.array(held[1], np.int64), kind="stable").tolist()
            for first in range(0, len(order), size or len(order)):
                own = order[first : first + (size or len(order))]
                yield pa.RecordBatch.from_pylist([_tile(*([h[i] for i in own] for h in held), dealt=dealt)], _ARROW)
                dealt = (dealt + 0.6180339887498949) % 1
            held[:], n_bytes = ([], [], []), 0

        for batch in batches:
            for column, name in enumerate(("vec_id", "label", "embedding")):
                held[column] += [v.values.to_numpy() for v in batch.column(name)] if name == "embedding" else batch.column(name).to_pylist()
            n_bytes += batch.nbytes
            if size and (len(held[0]) >= SORTED * size or len(held[0]) >= size and n_bytes >= SORTED_BYTES):
                yield from tiles()
        if held[0]:
            yield from tiles()

    return rows.mapInArrow(run, _TILE)


def _met(tiles: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Tiles and the groups they meet, each cell of ``HELD`` groups and a part of the tiles a partition of its own, groups
    first: tiles are dealt over parts, and a group goes to every part, so that a cell has its share of the tiles whatever
    the number of groups is. There are some cells for each core, as each hands on heaps of all its anchors."""
    spark = tiles.sparkSession
    blocks = -(-n_groups // HELD)
    parts = -(-min(2 * common.shards(spark), 4 * spark.sparkContext.defaultParallelism) // blocks)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = tiles.withColumn("block", numbers(blocks)).withColumn("cell", ((F.col("dealt") * parts).cast("int") * blocks + F.col("block")).cast("int"))
    to = groups.withColumn("part", numbers(parts)).withColumn("cell", (F.col("part") * blocks + F.col("group") % blocks).cast("int"))
    both = to.drop("part").unionByName(dealt.drop("block"), allowMissingColumns=True)
    return both.repartitionById(blocks * parts, "cell").sortWithinPartitions(F.col("group").isNull())


def _scored(met: DataFrame, keep: int, leaf: int, windows: bool) -> DataFrame:
    """(group, place, window, id, score): what each task's heaps keep of each anchor."""
    schema = "group int, place int, window int, id long, score long"

    def group(batch: pa.RecordBatch, row: int) -> Group:
        tile = Tile.read(batch, row)
        if not windows:
            return Group(tile, np.full((1, len(tile.ids)), _NONE), np.full((1, len(tile.ids)), LARGEST), keep)
        goals = np.array(batch.column("goals")[row].as_py() or [], np.int64).reshape(-1, 3)
        shape = int(goals[:, 1].max(initial=-1)) + 1, len(tile.ids)
        low, high = np.full(shape, LARGEST), np.full(shape, _NONE)
        low[goals[:, 1], goals[:, 0]], high[goals[:, 1], goals[:, 0]] = -(-goals[:, 2] // 2), 19 * goals[:, 2] // 20  # 50 to 95 %
        return Group(tile, low, high, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Group] = {}
        for batch in batches:
            for row, number in enumerate(batch.column("group").to_pylist()):
                if number is not None:
                    state[number] = group(batch, row)
                    continue
                tile = Tile.read(batch, row)
                for g in state.values():
                    x, y, side = g.against(tile, leaf)
                    if windows:
                        runs = [(0, len(g.ids), slice(0, len(tile.ids)))]
                    else:
                        names, start = np.unique(tile.labels, return_index=True)
                        from_, to = np.searchsorted(g.labels, names), np.searchsorted(g.labels, names, "right")
                        runs = [(a, b, slice(c, d)) for a, b, c, d in zip(from_.tolist(), to.tolist(), start.tolist(), [*start[1:].tolist(), len(tile.ids)]) if b > a]
                    for begin, end, some in runs:
                        for first in range(begin, end, ANCHORS):
                            g.offer(first, strassen(x[first : min(first + ANCHORS, end)], y[:, some], side), tile, some, not windows)
        for number, g in state.items():
            for window, h in enumerate(g.heaps):
                place, who, score = h.rows()
                full = lambda v: np.full(len(place), v, np.int32)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full(number), place.astype(np.int32), full(window), who, score)], ["group", "place", "window", "id", "score"])

    return met.mapInArrow(run, schema)


def _best(scored: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("group", "place", "window").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(table: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, group: int = GROUP, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    ``every`` and each of the ``n_positives`` best other rows of its label, the ``n_negatives`` best rows of other labels
    whose score is 50 to 95 % of the positive's; ties by the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors count as
    followed by zeros. Repeated rows are rows of their own, save that none of an anchor's own id is its positive, and
    each repeated anchor is mined. Empty tables give no rows, and other columns aren't looked at. Scores must be below
    2^58 by their bound (width times the largest components), else a task fails and says so.
    """
    rows = usable(table)
    tiles = common.written(packed(rows, tile), "negative-tiles")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_groups = max(1, -(-anchors.count() // group))
    groups = common.written(packed(anchors.repartition(n_groups), None).withColumn("group", F.spark_partition_id()), "anchor-groups")
    positives = common.written(_best(_scored(_met(tiles, groups, n_groups), n_positives, leaf, False), n_positives), "positives")
    goals = positives.groupBy("group").agg(F.collect_list(F.array(F.col("place").cast("long"), F.col("rank") - F.lit(1).cast("long"), "score")).alias("goals"))
    found = _best(_scored(_met(tiles, groups.join(goals, "group"), n_groups), n_negatives, leaf, True), n_negatives)
    own = positives.select("group", "place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = groups.select("group", F.posexplode("ids").alias("place", "anchor_id"))
    rows = found.join(own, ["group", "place", "window"]).join(names, ["group", "place"])
    return rows.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

