"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors divided by the largest norm get one more component that makes them unit vectors, so the nearest by distance to
a unit query are those of largest inner product. Each table floors shifted Gaussian projections; a query visits the
buckets whose projections lie just beyond its own cell's walls, in order of estimated success, which for sets of walls
is the sum of their squared distances. Expected distances order the sets once for all queries, and each query ranks
its own walls. Equal vectors are hashed once, with as many of their smallest ids as any answer can need.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common, words

TABLES = 4
WIDTH = 2.0
#: Vectors a bucket should hold, on average.
BUCKET = 32
#: Queries, with their exact neighbours among all rows, that set how many buckets are visited, and the share of those
#: neighbours to be met by then.
SAMPLE = 128
RECALL = 0.97
#: Sets of walls that are tried before buckets are made wider; vectors of a bucket beyond which it is split; vectors, and
#: queries, that a task of the scan holds, about.
MOST_SETS, HOT, HELD, SCANNED = 8192, 1 << 14, 1 << 16, 1 << 14
#: Bytes of vectors (once a table) that a task of the search holds, about, and queries that meet them at a time; the owners
#: and members of a bucket that are multiplied at once; pairs after which bounds are raised.
HELD_BYTES, ASKED, BLOCK, RAISED = 1 << 25, 1 << 14, (512, 256), 1 << 18
#: Vectors, and bytes of them, among which queries find the bounds they start with, at most; their share is a 16th at most.
DRAWN, DRAWN_BYTES = 1 << 14, 1 << 23


def perturbations(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of wall ranks (0 nearest, 2k in all) in order of expected score; a set has one wall of a projection at
    most, which by symmetry are ranks j and 2k - 1 - j. The empty set, the query's own bucket, is first."""
    if k == 0:
        return [()]
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2))
    cost = np.concatenate([near, far[::-1]])
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        score, s = heapq.heappop(heap)
        if all(2 * k - 1 - x not in s for x in s):
            out.append(s)
        last = s[-1] + 1
        if last < 2 * k:
            heapq.heappush(heap, (score - cost[s[-1]] + cost[last], (*s[:-1], last)))
            heapq.heappush(heap, (score + cost[last], (*s, last)))
    return out


class Tables:
    """The projections of all tables, from a seed."""

    def __init__(self, dim: int, k: int, tables: int = TABLES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k, self.tables = k, tables
        self.a = rng.standard_normal((dim + 1, tables * k))
        self.b = rng.uniform(0, WIDTH, tables * k)
        self.odd = rng.integers(1, 2**62, (tables, max(k, 1)), np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 2**62, tables, np.uint64)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers (rows, tables, k) and places within the cells, from 0 to 1."""
        p = ((unit @ self.a + self.b) / WIDTH).reshape(len(unit), self.tables, self.k)
        cell = np.floor(p)
        return cell.astype(np.int64), p - cell

    def bucket(self, cell: np.ndarray) -> np.ndarray:
        """Bucket of cell numbers (..., tables, k)."""
        return words.mix((cell.astype(np.uint64) * self.odd[:, : self.k]).sum(-1, dtype=np.uint64) + self.salt)

    def probes(self, unit: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
        """Buckets (rows, tables, sets) that queries visit, in order: of sums over cells, to which a step through a wall adds
        its projection's factor or takes it away."""
        cell, place = self.cells(unit)
        base = (cell.astype(np.uint64) * self.odd[:, : self.k]).sum(-1, dtype=np.uint64) + self.salt
        out = np.repeat(base[..., None], len(sets), -1)
        if self.k:
            wall = np.argsort(np.concatenate([place, 1 - place], -1), -1)
            step = self.odd[np.arange(self.tables)[:, None], wall % self.k]
            step = np.concatenate([np.where(wall < self.k, -step, step), np.zeros_like(step[..., :1])], -1)  # the last is no step
            for ranks in itertools.zip_longest(*sets, fillvalue=2 * self.k):
                out += step[..., np.array(ranks)]
        return words.mix(out)


def _packed(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _matrix(column, dim: int, kind: str = "<f8") -> np.ndarray:
    return _packed(column, dim, kind).astype(np.float64)


def _unit(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])


def _query_unit(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])


def _best(scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k largest scores over the ids of each column, ties to smaller ids."""
    take = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return sorted((-float(scores[c]), i) for c in take for i in ids[c])[:k]


def _places(row: np.ndarray) -> np.ndarray:
    """Of sorted numbers, each one's place among its equals."""
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(np.append(True, row[1:] != row[:-1])[: len(row)], at, 0))


def _first(row: np.ndarray, s: np.ndarray, i: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` first different (s, i) of each row, in order."""
    order = np.lexsort((i, s, row))
    row, s, i = row[order], s[order], i[order]
    new = np.append(True, (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]))[: len(row)]
    row, s, i = row[new], s[new], i[new]
    take = _places(row) < keep
    return row[take], s[take], i[take]


def _lists(row: np.ndarray, s: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The rows there are, and their (s, i) as lists."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    pairs = pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(i, pa.int64())], ["s", "i"])
    return row[start], pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pairs)


def _flat(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of (s, i): each pair's list, s and i."""
    pairs = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, pairs.field("s").to_numpy(zero_copy_only=False), pairs.field("i").to_numpy(zero_copy_only=False)


def _merged(found: DataFrame, key: str, keep: int) -> DataFrame:
    """(key, found): the ``keep`` first different pairs of all rows of a key, which are sorted to follow one another."""
    schema = found.select(key, "found").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pairs = None, None  # the key before, and its pairs so far
        for batch in batches:
            if not batch.num_rows:
                continue
            names, (row, s, i) = batch.column(0).to_pylist(), _flat(batch.column(1))
            if last is not None:
                names, row = [last, *names], np.concatenate([np.zeros(len(pairs[0]), np.int64), row + 1])
                s, i = np.concatenate([pairs[0], s]), np.concatenate([pairs[1], i])
            number = np.cumsum([False, *(x != y for x, y in zip(names[1:], names))])
            row, s, i = _first(number[row], s, i, keep)
            last, own = names[-1], row == number[-1]
            pairs = s[own], i[own]
            at, lists = _lists(row[~own], s[~own], i[~own])
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in np.searchsorted(number, at)], batch.schema.field(0).type), lists], [key, "found"])
        if last is not None:
            _, lists = _lists(np.zeros(len(pairs[0]), np.int64), *pairs)
            yield pa.RecordBatch.from_arrays([pa.array([last][: len(lists)], batch.schema.field(0).type), lists], [key, "found"])

    return found.select(key, "found").repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query, each summed in the same way."""
    return (x * q).sum(1)


def _slack(q: np.ndarray, norm: float) -> float:
    """What two ways of summing a product of ``q`` with a vector of the largest norm can differ by, and more."""
    return 4 * len(q) * np.finfo(np.float64).eps * float(np.linalg.norm(q)) * norm


def _among(rough: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of all that could be among the ``k`` best, however the sums were rounded, so that ties are told by ids."""
    if len(rough) <= k:
        return np.arange(len(rough))
    return np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack)


class _Met:
    """Pairs of queries (rows) and held vectors (columns) that could be among a query's ``keep`` best, by bounds.

    Products of vectors brought to the length of one at most are summed in 32 bits; what that can change is added, so a
    score isn't above its bound. A table's buckets share no vector, so the ``keep``-th largest of its scores less
    what rounding can add is one that a query's best must reach."""

    def __init__(self, x: np.ndarray, q: np.ndarray, least: np.ndarray, keep: int):
        """``least``: scores that a query's best are known to reach. Where products could leave the range of 64 bits, all
        that meet are left, as only the scores tell how they come out."""
        dim, x, q = x.shape[1], x.astype(np.float64), q.astype(np.float64)
        top, own = np.abs(x).max(), np.abs(q).max(1, keepdims=True)
        x, q = x / top, q / own
        wrong = (dim + 8) * np.finfo(np.float32).eps * np.sqrt((x * x).sum(1)) + 1e-35
        self.x = np.column_stack([x, wrong]).astype(np.float32)
        self.x[:, -1] = np.nextafter(self.x[:, -1], np.float32(np.inf))
        length = np.sqrt((q * q).sum(1))
        self.q = np.column_stack([q / length[:, None], np.ones(len(q))]).astype(np.float32)
        self.keep, self.often = keep, max(RAISED, keep * len(q))
        size = np.log(top) + np.log(own[:, 0])
        if size.min() > -600 and size.max() < 600:
            least = least / (length * own[:, 0]) / top
            self.least = np.nextafter((least - 1e-12 * np.abs(np.nan_to_num(least))).astype(np.float32), np.float32(-np.inf))
        else:
            self.keep, self.least = len(x) + 1, np.full(len(q), -np.inf, np.float32)
        self.top, self.held, self.new, self.n_new = np.empty(0, np.uint64), [], [], 0

    def meet(self, rows: np.ndarray, first: int, past: int) -> None:
        """Queries ``rows`` meet the vectors from ``first`` to ``past``."""
        for b in range(first, past, BLOCK[1]):
            x = self.x[b : min(b + BLOCK[1], past)]
            for a in range(0, len(rows), BLOCK[0]):
                own = rows[a : a + BLOCK[0]]
                bound = self.q.take(own, 0) @ x.T
                hit = bound >= self.least[own, None]
                some = np.flatnonzero(hit.any(1))
                if len(some):
                    r, c = np.divmod(np.flatnonzero(hit[some]), hit.shape[1])
                    r = some[r]
                    self.new.append((own[r].astype(np.int32), (b + c).astype(np.int32), bound[r, c]))
                    self.n_new += len(r)
                    if self.n_new >= self.often:
                        self.raised()

    def raised(self, over: bool = False) -> None:
        """Raise the bounds by the pairs met since; ``over``: of the table's last."""
        if self.n_new:
            row, col, bound = map(np.concatenate, zip(*self.new))
            bits = (bound - 3 * self.x[col, -1]).view(np.uint32)
            down = np.where(bits >> np.uint32(31), bits, ~(bits | np.uint32(1 << 31)))  # larger ones first
            self.top = np.sort(np.concatenate([self.top, row.astype(np.uint64) << np.uint64(32) | down]))
            who = (self.top >> np.uint64(32)).astype(np.int64)
            place = _places(who)
            self.top, who, place = (v[place < self.keep] for v in (self.top, who, place))
            down = self.top[place == self.keep - 1].astype(np.uint32)
            bits = np.where(down >> np.uint32(31), down, ~(down | np.uint32(1 << 31)))
            who = who[place == self.keep - 1]
            self.least[who] = np.maximum(self.least[who], bits.view(np.float32))
            can = bound >= self.least[row]
            self.held.append((row[can], col[can], bound[can]))
            self.new, self.n_new = [], 0
        if over:
            self.top = self.top[:0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns that are left."""
        row, col, bound = map(np.concatenate, zip((np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32)), *self.held))
        can = bound >= self.least[row]
        return row[can], col[can]


class _Drawn:
    """Some vectors, drawn by a hash, and their buckets: what queries meet among them bounds what they find among all."""

    def __init__(self, distinct: DataFrame, hashes: Tables, norm: float, dim: int, n: int, kind: str):
        most = min(DRAWN, DRAWN_BYTES // (8 * dim), n // 16)
        rows = distinct.where(F.pmod(F.xxhash64("v"), F.lit(n // most)) == 0).select("v").limit(2 * most).collect() if most else []
        x = np.frombuffer(b"".join(bytes(r["v"]) for r in rows), kind).reshape(-1, dim).astype(np.float64)
        self.x, self.bucket = (x / norm).astype(np.float32), hashes.bucket(hashes.cells(_unit(x, norm))[0])

    def bounds(self, q: np.ndarray, visited: np.ndarray, keep: int, norm: float) -> np.ndarray:
        """What the ``keep`` best of each query reach, by the best of those it meets in its ``visited`` (rows, sets, tables)."""
        least, length = np.full(len(q), -np.inf), np.linalg.norm(q, axis=1)
        some, parts = 4 * keep, min(12 * keep, len(self.x))
        if parts < some:
            return least
        scores = (q / length[:, None]).astype(np.float32) @ self.x.T
        most = scores[:, : scores.shape[1] // parts * parts].reshape(len(q), parts, -1).max(-1)  # so many at least reach the ``some``-th of these
        hit, c = np.divmod(np.flatnonzero(scores >= np.partition(most, parts - some, axis=1)[:, parts - some, None]), scores.shape[1])
        by = np.lexsort((-scores[hit, c], hit))
        hit, c = hit[by], c[by]
        first = np.searchsorted(hit, np.arange(len(q) + 1))
        visited = np.sort(np.moveaxis(visited, 2, 1), -1)
        for row, own in enumerate(visited):
            mine = c[first[row] : first[row + 1]]
            met = np.zeros(len(mine), bool)
            for b, v in zip(self.bucket[mine].T, own):
                met |= v[np.minimum(np.searchsorted(v, b), len(v) - 1)] == b
            if np.count_nonzero(met) >= keep:
                least[row] = (float(scores[row, mine[met][keep - 1]]) - (q.shape[1] + 8) * np.finfo(np.float32).eps) * length[row] * norm
        return least


class _Held:
    """The vectors of a task, sorted by their buckets' names."""

    def __init__(self, held: pa.Table, dim: int, kind: str):
        name = held["bucket"].to_numpy().view(np.uint32)
        by = np.argsort(name, kind="stable")
        self.dim, self.kind, self.x = dim, kind, _packed(held["v"], dim, kind)[by]
        ids = held["ids"].combine_chunks().take(pa.array(by))
        self.many, self.ids = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
        self.names, self.first = np.unique(name[by], return_index=True)
        self.past = np.append(self.first[1:], len(by))

    def nearest(self, asked: pa.Table, keep: int, tables: int) -> tuple[pa.Array, pa.Array]:
        """The queries that met vectors, and the ``keep`` best (s, i) of each."""
        q, lists = _packed(asked["v"], self.dim, self.kind), asked["buckets"].to_pylist()
        to = np.frombuffer(b"".join(lists), np.uint32)
        row = np.repeat(np.arange(len(lists)), [len(v) // 4 for v in lists])
        at = np.minimum(np.searchsorted(self.names, to), len(self.names) - 1)
        there = self.names[at] == to
        at, row = at[there], row[there]
        row = row[np.argsort(at, kind="stable")]
        owned = np.bincount(at, minlength=len(self.names))
        owners = np.append(0, np.cumsum(owned))
        met = _Met(self.x, q, asked["least"].to_numpy(), keep)
        for t in range(tables):
            own = np.flatnonzero((self.names % tables == t) & (owned > 0))
            for b in own[np.argsort(self.first[own] - self.past[own], kind="stable")].tolist():  # large ones first
                met.meet(row[owners[b] : owners[b + 1]], self.first[b], self.past[b])
            met.raised(over=True)
        row, col = met.pairs()
        parts = [slice(a, a + (1 << 16)) for a in range(0, len(row), 1 << 16)]
        s = np.concatenate([np.empty(0), *(_exact(q[row[p]].astype(np.float64), self.x[col[p]].astype(np.float64)) for p in parts)])
        many = self.many[col]
        each = np.repeat(np.arange(len(row)), many)
        i = self.ids[np.repeat((np.cumsum(self.many) - self.many)[col] - (np.cumsum(many) - many), many) + np.arange(len(each))]
        row, found = _lists(*_first(row[each], -s[each], i, keep))
        return asked["query"].combine_chunks().take(pa.array(row)), found


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` rows of largest inner
    product found among all others, in double precision.

    Vectors that are null, zero or hold a null or a component that isn't finite take no part, nor do those of another
    length than most; rows without an id neither. Rows equal in id and vector count once. Up to ``BUCKET`` vectors all
    are candidates. A bucket holds distinct vectors only; one with very many is dealt over several tasks, which its
    queries all visit. Queries that meet too few vectors are answered by a scan of all, in one job. An empty table gives
    an empty result; other columns, whatever their names, are not looked at.
    """
    spark = table.sparkSession
    kind, v = ("<f4", F.col(vector_col)) if isinstance(table.schema[vector_col].dataType.elementType, FloatType) else ("<f8", F.col(vector_col).cast("array<double>"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, keep = sizes["d"], k + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = np.where(x == 0, np.zeros((), kind), x)  # one zero
            found: dict[bytes, list[int]] = {}
            for i, row in zip(batch.column(0).to_pylist(), x):
                found.setdefault(row.tobytes(), []).append(i)
            asked = [sorted(i for i in own if i % every == 0) for own in found.values()]
            norms = np.sqrt((np.frombuffer(b"".join(found), kind).reshape(-1, dim).astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([sorted(set(own))[:keep] for own in found.values()], pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int64())), pa.array(norms)],
                ["v", "ids", "asked", "norm"])

    packed = rows.where(F.size("v") == dim).mapInArrow(pack, "v binary, ids array<long>, asked array<long>, norm double")
    packed = common.written(packed, "vectors")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    distinct = common.written(packed.groupBy("v").agg(smallest.alias("ids"), F.max(F.size("asked") > 0).alias("queried"), F.max("norm").alias("norm")), "distinct")
    n, norm = distinct.agg(F.count(F.lit(1)), F.max("norm")).first()
    queries = common.written(distinct.where("queried").select(F.monotonically_increasing_id().alias("query"), "v"), "queries")
    hashes, visited = _hashes(distinct, queries, n, norm, dim, k, tables, kind)
    shards = max(common.shards(spark), n * tables * dim * np.dtype(kind).itemsize // HELD_BYTES)
    split, drawn = _split_buckets(distinct, hashes, norm, dim, n, kind), _Drawn(distinct, hashes, norm, dim, n, kind)
    named = lambda b: (b >> np.uint64(32)) // np.uint64(tables) * np.uint64(tables) + np.arange(tables, dtype=np.uint64)  # noqa: E731  within a shard, by table; if two share one, more is met

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = hashes.cells(_unit(_matrix(batch.column(0), dim, kind), norm))
            bucket = hashes.bucket(cell)
            name = named(bucket).astype(np.uint32).view(np.int32)
            own = np.array([zlib.crc32(v) for v in batch.column(0).to_pylist()], np.uint64)
            for t in range(tables):
                b = bucket[:, t]
                parts = np.array([split.get(x, 1) for x in b.tolist()], np.uint64) if split else np.uint64(1)
                shard = (b + own % parts) % np.uint64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(name[:, t]), batch.column(0), batch.column(1)], ["shard", "bucket", "v", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = max(1, min(256, (1 << 22) // (tables * len(visited))))
        hot = np.array(sorted(split), np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                part = batch.slice(at, many)
                bucket = hashes.probes(_query_unit(_matrix(part.column(1), dim, kind)), visited)
                name = named(np.moveaxis(bucket, 1, 2))
                bucket, name = np.moveaxis(bucket, 1, 2).reshape(len(part), -1), name.reshape(len(part), -1)
                row = np.repeat(np.arange(len(part), dtype=np.uint64), bucket.shape[1])
                visits = [(row, bucket.ravel() % np.uint64(shards), name.ravel())]
                for j in np.flatnonzero(np.isin(bucket.ravel(), hot)) if len(hot) else ():
                    b = bucket.ravel()[j]
                    on = (b + np.arange(1, split[int(b)], dtype=np.uint64)) % np.uint64(shards)
                    visits.append((np.full(len(on), row[j]), on, np.full(len(on), name.ravel()[j])))
                row, shard, name = map(np.concatenate, zip(*visits))
                name = name[by := np.lexsort((name, shard, row))].astype(np.uint32)
                to = (row * np.uint64(shards) + shard)[by]
                fresh = np.append(True, (to[1:] != to[:-1]) | (name[1:] != name[:-1]))
                to, name = to[fresh], name[fresh]
                start = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                to = to[start].astype(np.int64)
                names = pa.Array.from_buffers(pa.binary(), len(to), [None, pa.py_buffer(np.append(start, len(name)).astype(np.int32) * np.int32(4)), pa.py_buffer(name)])
                query = pa.array(to // shards)
                least = drawn.bounds(_matrix(part.column(1), dim, kind), bucket.reshape(len(part), -1, tables), keep, norm)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((to % shards).astype(np.int32)), part.column(0).take(query), part.column(1).take(query), names, pa.array(least[to // shards])], ["shard", "query", "v", "buckets", "least"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, asked, n_asked = None, [], [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:  # vectors come before queries
                many = batch.column("query").null_count
                held += [batch.slice(0, many).select(["bucket", "v", "ids"])] * (many > 0)
                asked += [batch.slice(many).select(["query", "v", "buckets", "least"])] * (many < batch.num_rows)
                n_asked += batch.num_rows - many
            if asked and held and (batch is None or n_asked >= ASKED):
                index = index or _Held(pa.Table.from_batches(held), dim, kind)
                query, found = index.nearest(pa.Table.from_batches(asked), keep, tables)
                yield from pa.table({"query": query, "found": found}).to_batches()
                asked, n_asked = [], 0

    both = distinct.select("v", "ids").mapInArrow(index, "shard int, bucket int, v binary, ids array<long>").unionByName(
        queries.repartition(shards).mapInArrow(ask, "shard int, query long, v binary, buckets binary, least double"), allowMissingColumns=True)
    found = both.repartitionById(shards, "shard").sortWithinPartitions(F.col("query").isNotNull()).mapInArrow(search, "query long, found array<struct<s:double,i:long>>")
    merged = common.written(queries.join(_merged(found, "query", keep), "query", "left").select(F.col("v").alias("q"), "found"), "found")
    few = merged.where(f"found is null or size(found) < {keep}").select("q")
    if hashes.k and few.limit(1).count():
        merged = merged.join(few, "q", "left_anti").unionByName(_scanned(distinct, few, n, norm, dim, keep, kind))
    asked = packed.where(F.size("asked") > 0).select("v", F.explode("asked").alias("query_id")).distinct()
    answers = asked.join(merged, asked.v == merged.q, "left").select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["i"] != F.col("query_id")), 1, k)).alias("p", "f"))
    return answers.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.i").alias("vec_id"), (-F.col("f.s")).alias("score"))


def _hashes(distinct: DataFrame, queries: DataFrame, n: int, norm: float, dim: int, k: int, tables: int, kind: str) -> tuple[Tables, list[tuple[int, ...]]]:
    """Projections and the sets of walls to visit that meet ``RECALL`` of a sample's neighbours: where ``MOST_SETS`` don't,
    buckets get wider by a projection less, down to one bucket."""
    width = max(0, round(math.log2(max(n, 1) / BUCKET) / 1.5))
    sample = [bytes(r["v"]) for r in queries.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    q = np.frombuffer(b"".join(sample), kind).reshape(-1, dim).astype(np.float64)
    best = _nearest_of(distinct, q, k, kind) if width and len(q) else []
    while True:
        hashes = Tables(dim, width, tables)
        sets = perturbations(width, 3**width if width < 9 else MOST_SETS)
        if not width or not best:
            return hashes, sets
        probes, needed = hashes.probes(_query_unit(q), sets), []
        for i, x in best:
            for b in hashes.bucket(hashes.cells(_unit(x, norm))[0]):
                hit = probes[i] == b[:, None]
                needed.append(int(np.where(hit.any(1), hit.argmax(1), len(sets)).min()))
        most = int(np.quantile(needed, RECALL, method="higher"))
        if most < len(sets):
            return hashes, sets[: most + 1]
        width -= 1


def _split_buckets(distinct: DataFrame, hashes: Tables, norm: float, dim: int, n: int, kind: str) -> dict[int, int]:
    """Parts of the buckets with more than ``HOT`` vectors, or a ten-thousandth of all; there can't be more than some ten
    thousand of them."""
    most = max(HOT, n * hashes.tables // 10_000)
    if n <= most:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, c = np.unique(hashes.bucket(hashes.cells(_unit(_matrix(batch.column(0), dim, kind), norm))[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(c)], ["bucket", "n"])

    rows = distinct.select("v").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(f"n > {most}").collect()
    return {r["bucket"] % 2**64: -(-r["n"] // most) for r in rows}


def _nearest_of(distinct: DataFrame, q: np.ndarray, k: int, kind: str) -> list[tuple[int, np.ndarray]]:
    """(number, its ``k`` nearest vectors) of each of a few queries, among all."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, v = np.empty((len(q), 0)), np.empty((len(q), 0, q.shape[1]), kind)  # of the task's vectors so far
        for batch in batches:
            x, had = _packed(batch.column(0), q.shape[1], kind), best.shape[1]
            if len(x):
                scores = np.hstack([best, q @ x.astype(np.float64).T])
                m = min(k, scores.shape[1])
                top = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                new = x[np.maximum(top - had, 0)]
                v = np.where((top < had)[..., None], np.take_along_axis(v, np.minimum(top, had - 1)[..., None], 1), new) if had else new
                best = np.take_along_axis(scores, top, 1)
        if best.size:
            flat = pa.array([row.tobytes() for row in v.reshape(-1, q.shape[1])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best.shape[1])), pa.array(best.ravel()), flat], ["q", "s", "v"])

    best = distinct.select("v").mapInArrow(exact, "q long, s double, v binary").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "v")), False), 1, k).alias("b")).collect()
    return [(r["q"], np.frombuffer(b"".join(bytes(b["v"]) for b in r["b"]), kind).reshape(-1, q.shape[1]).astype(np.float64)) for r in best]


def _scanned(distinct: DataFrame, few: DataFrame, n: int, norm: float, dim: int, keep: int, kind: str = "<f8") -> DataFrame:
    """(q, found) of the vectors ``few`` by comparing them with all ``n`` in one job: groups of about ``SCANNED`` queries
    meet parts of about ``HELD`` vectors, each meeting keeps its best, and these are merged."""
    parts = max(common.shards(distinct.sparkSession), n // HELD)
    groups = max(1, few.count() // SCANNED)

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out = [], []
        if held.num_rows and asked.num_rows:
            x, ids = _matrix(held["v"], dim, kind), held["ids"].to_pylist()
            names = asked["q"].to_pylist()
            q = _matrix(asked["q"], dim, kind)
            for first in range(0, len(q), 64):
                for row, rough in enumerate(q[first : first + 64] @ x.T, first):
                    c = _among(rough, keep, _slack(q[row], norm))
                    out_q.append(names[row])
                    out.append([{"s": s, "i": i} for s, i in _best(_exact(q[row], x[c]), [ids[j] for j in c], keep)])
        return pa.table({"q": pa.array(out_q, pa.binary()), "found": pa.array(out, pa.list_(pa.struct([("s", pa.float64()), ("i", pa.int64())])))})

    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = distinct.select(F.pmod(F.crc32("v"), F.lit(parts)).cast("int").alias("part"), numbers(groups).alias("group"), "v", "ids")
    asked = few.select(numbers(parts).alias("part"), F.pmod(F.crc32("q"), F.lit(groups)).cast("int").alias("group"), "q")
    met = held.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(meet, "q binary, found array<struct<s:double,i:long>>")
    return common.written(_merged(met, "q", keep), "scanned")
