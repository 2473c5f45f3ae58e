"""Interpolated modified Kneser-Ney n-gram models, counted in Spark and kept as sorted hash arrays.

Tokens are lower-cased words and one end a document; a history shorter than the order begins with begin marks. The
highest level counts n-grams, every lower one the distinct words seen before its n-grams. Level 1 is keyed by the
64-bit word hash, a higher level by 34 bits of its context's hash and 30 of the word's, in shards dealt by other bits
of the context, so a context and all that follows it is in one shard and fingerprints grow with the shards.

Blocks send their distinct n-grams of the highest level, each once, to the shard of its context, words as numbers in a
small dictionary of the row. A shard's task sorts and adds them up, writes arrays to the shared folder, which workers
map into memory, and counts the next lower level from its own: each distinct n-gram is one word before the rest of it.
As the shards' n-grams are disjoint, so are these counts, and the next level's shards add them up: a word with very
many others before it costs each of them a number.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing, words

BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFEB1B2C9)
WORD_BITS = np.uint64(30)
WORD_MASK = np.uint64((1 << 30) - 1)
BLOCK_TOKENS = 1 << 21
#: Entries of a context up to which its sums are taken anew for each block instead of being kept.
SMALL = 8


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the arrays: a few numbers a level. ``tokens``: N, ``types``: V."""

    folder: str
    files: tuple[tuple[tuple[int, int], str], ...]
    order: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]
    tokens: int
    types: int
    base_total: int
    base_gamma: float


def token_stream(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with begin marks, the places of those to predict, and how many each text has."""
    h, counts = words.word_hashes(texts)
    span = counts + order
    first = np.cumsum(span) - span
    tokens = np.full(int(span.sum()), BEGIN, np.uint64)
    tokens[np.arange(len(h)) + np.repeat(first + order - 1 - (np.cumsum(counts) - counts), counts)] = h
    tokens[first + order - 1 + counts] = END
    at = np.arange(int((counts + 1).sum())) + np.repeat(first + order - 1 - (np.cumsum(counts + 1) - counts - 1), counts + 1)
    return tokens, at, counts + 1


def level_keys(tokens: np.ndarray, at: np.ndarray, level: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and shard of the ``level``-gram that ends at each of ``at``."""
    n = np.uint64(shards)
    if level == 1:
        return tokens[at], tokens[at] % n
    context = words.gram_hashes(tokens, level - 1)[at - (level - 1)]
    return (context >> WORD_BITS << WORD_BITS) | (words.mix(tokens[at]) & WORD_MASK), (context & WORD_MASK) % n


_ENTRIES = {"shard": pa.int32(), "dictionary": pa.binary(), "places": pa.list_(pa.binary()), "counts": pa.binary(), "raws": pa.binary(), "stats": pa.list_(pa.int64()), "file": pa.string()}
_ENTRIES_SQL = "shard int, dictionary binary, places array<binary>, counts binary, raws binary, stats array<long>, file string"


def _context_shard(grams: list[np.ndarray], shards: int) -> np.ndarray:
    """Shard of each n-gram, given as the columns of its words: that of its context, or of the word of a unigram."""
    return (words.combined(grams[:-1]) & WORD_MASK) % np.uint64(shards) if len(grams) > 1 else grams[0] % np.uint64(shards)


def _packed_entries(grams: list[np.ndarray], count: np.ndarray, raw: np.ndarray, shards: int) -> list[tuple]:
    """A row a shard of distinct n-grams: words are places in the row's dictionary, in order of the first word."""
    by, bounds = packing.by_shard(_context_shard(grams, shards), shards)
    rows = []
    for s in np.flatnonzero(np.diff(bounds)):
        own = by[bounds[s] : bounds[s + 1]]
        own = own[np.argsort(grams[0][own])]
        known, place = np.unique(np.concatenate([g[own] for g in grams]), return_inverse=True)
        first, *rest = np.split(place.astype(np.uint64), len(grams))
        rows.append((int(s), packing.pack_sorted(known), [packing.pack_sorted(first), *map(packing.pack, rest)], packing.pack(count[own]), packing.pack(raw[own]), None, None))
    return rows


def _unpacked_entries(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    grams = []
    for r in rows:
        known, (first, *rest) = packing.unpack_sorted(r["dictionary"]), r["places"]
        grams.append([known[packing.unpack_sorted(first).astype(np.int64)], *(known[packing.unpack(p).astype(np.int64)] for p in rest)])
    return [np.concatenate(c) for c in zip(*grams)], *(np.concatenate([packing.unpack(r[c]) for r in rows]).astype(np.int64) for c in ("counts", "raws"))


def _table(rows: list[tuple], kind: type):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_ENTRIES), _ENTRIES.values())]
    return kind.from_arrays(columns, list(_ENTRIES))


def _distinct(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """The place of the first of each distinct key, in their order, and each of ``sums`` added up."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    return order[starts], *(np.add.reduceat(x[order], starts) for x in sums)


def _count_blocks(order: int, shards: int):
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        base = np.cumsum([0] + [len(t) for t, _ in held[:-1]])
        tokens, at = np.concatenate([t for t, _ in held]), np.concatenate([a + b for (_, a), b in zip(held, base)])
        grams = [tokens[at - k] for k in range(order - 1, -1, -1)]
        first, count = _distinct(words.combined(grams), np.ones(len(at), np.int64))
        return _table(_packed_entries([g[first] for g in grams], count, count, shards), pa.RecordBatch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            texts = words.as_bytes(batch.column(0))
            for a, b in words.slices(texts):
                tokens, at, _ = token_stream(texts[a:b], order)
                held.append((tokens, at))
                n += len(at)
                if n >= BLOCK_TOKENS:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _save(folder: str, name: str, **arrays: np.ndarray) -> str:
    """Write arrays under a name of this attempt's own, and return it: only names in committed rows are ever read."""
    name = f"{name}-{uuid.uuid4().hex}"
    for key, a in arrays.items():
        fs, path = common.filesystem(f"{folder}/{name}-{key}.npy")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        buf = io.BytesIO()
        np.save(buf, a)
        with fs.open_output_stream(path) as out:
            out.write(buf.getbuffer())
    return name


def _reduce_level(level: int, folder: str, shards: int):
    """Add up a shard's n-grams of ``level``, write its arrays, and return its statistics and the entries of the level
    below; statistics of higher levels pass through."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [tuple(r[c] for c in _ENTRIES) for r in rows if r["stats"] is not None]
        rows = [r for r in rows if r["stats"] is None]
        if not rows:
            return _table(out, pa.Table)
        shard = rows[0]["shard"]
        grams, count, raw = _unpacked_entries(rows)
        # counted by all bits of its words: the 30 of a key that are the word's are shared by some words of a large context
        first, c, raw = _distinct(grams[0] if level == 1 else words.combined(grams), count, raw)
        grams = [g[first] for g in grams]
        if level == 1:
            arrays = {"key": grams[0], "count": packing.narrow(c), "raw": packing.narrow(raw)}
        else:
            key = (words.combined(grams[:-1]) >> WORD_BITS << WORD_BITS) | (words.mix(grams[-1]) & WORD_MASK)
            at, same = _distinct(key, c)
            k = key[at]
            context = k >> WORD_BITS
            starts = np.flatnonzero(np.diff(context, prepend=~context[:1]))
            large = np.diff(np.append(starts, len(k))) > SMALL
            sums = {"total": same} | {f"n{j}": (same == j if j < 3 else same >= 3).astype(np.int64) for j in (1, 2, 3)}
            arrays = {"key": k, "count": packing.narrow(same), "context": context[starts][large]} | {n: packing.narrow(np.add.reduceat(x, starts)[large]) for n, x in sums.items()}
            rest, seen, total = _distinct(words.combined(grams[1:]), np.ones(len(c), np.int64), raw)
            out += _packed_entries([g[rest] for g in grams[1:]], seen, total, shards)
        name = _save(folder, f"{level}-{shard}", **arrays)
        out.append((shard, None, None, None, None, [level, shard, *(int((c == j).sum()) for j in (1, 2, 3, 4)), len(c), int(c.sum()), int(raw.sum())], name))
        return _table(out, pa.Table)

    return run


def train(docs: DataFrame, order: int, text_col: str = "text", shards: int | None = None) -> Model:
    """Count all of ``docs`` and write the model's arrays to the shared folder. Null and empty texts count one end."""
    spark = docs.sparkSession
    folder, shards = common.fresh_path(spark, "kneser-ney"), shards or common.shards(spark)
    rows = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(_count_blocks(order, shards), _ENTRIES_SQL)
    for level in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(_reduce_level(level, folder, shards), _ENTRIES_SQL)
    names = ("level", "shard", "n1", "n2", "n3", "n4", "types", "total", "tokens")
    stats = [dict(zip(names, r["stats"])) | {"file": r["file"]} for r in rows.select("stats", "file").collect()]  # one a level and shard
    sums = {level: {n: sum(r[n] for r in stats if r["level"] == level) for n in names[2:]} for level in {r["level"] for r in stats}}
    files = tuple(((r["level"], r["shard"]), r["file"]) for r in stats)
    discounts = []
    for level in range(1, order + 1):
        n = [float(sums[level][f"n{j}"]) if level in sums else 0.0 for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        # the usual estimates; a corpus too small to have them gets a half
        discounts.append(tuple(min(j, max(0.0, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] and n[j] else 0.5 for j in (1, 2, 3)))
    one = sums.get(1)
    total, types = (one["total"], one["types"]) if one else (0, 0)
    d = discounts[0]
    gamma = (d[0] * one["n1"] + d[1] * one["n2"] + d[2] * (types - one["n1"] - one["n2"])) / total if total else 1.0
    return Model(folder, files, order, shards, tuple(discounts), one["tokens"] if one else 0, types, total, gamma)


@lru_cache(1 << 16)
def _mapped(folder: str, name: str) -> np.ndarray:
    """An array of the model, mapped into memory. A remote one is copied first."""
    fs, path = common.filesystem(f"{folder}/{name}.npy")
    if fs.type_name != "local":
        with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile(suffix=".npy") as local:
            local.write(f.read())
            local.flush()
            return np.load(local.name, mmap_mode="r")
    return np.load(path, mmap_mode="r")


def _find(sorted_keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ascending ``q`` is, and whether it is."""
    at = np.minimum(np.searchsorted(sorted_keys, q), len(sorted_keys) - 1)
    return at, sorted_keys[at] == q


def _context_sums(folder: str, name: str, keys: np.ndarray, counts: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ascending ``context``: the sum of its counts, 0 where it wasn't seen, and how many are 1, 2 and more.
    Small contexts are added up from their entries, large ones are kept."""
    own, which = np.unique(context, return_inverse=True)
    low, high = np.searchsorted(keys, own << WORD_BITS), np.searchsorted(keys, (own << WORD_BITS) | WORD_MASK, "right")
    total, many = np.zeros(len(own)), np.zeros((3, len(own)))
    small = np.flatnonzero(high - low <= SMALL)
    for k in range(SMALL):
        small = small[low[small] + k < high[small]]
        c = counts[low[small] + k].astype(np.int64)
        total[small] += c
        for j in range(3):
            many[j][small] += c == j + 1 if j < 2 else c >= 3
    large = np.flatnonzero(high - low > SMALL)
    if len(large):
        at, _ = _find(_mapped(folder, f"{name}-context"), own[large])
        total[large] = _mapped(folder, f"{name}-total")[at]
        for j in range(3):
            many[j][large] = _mapped(folder, f"{name}-n{j + 1}")[at]
    return total[which], many[:, which]


def token_scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability and training count of each token, and the number of tokens of each text.

    The tokens are joined with one shard of counts at a time, both in key order.
    """
    tokens, at, n = token_stream(texts, model.order)
    files = dict(model.files)
    p = np.full(len(at), 1.0 / (model.types + 1))
    known = np.zeros(len(at), np.int64)
    for level in range(1, model.order + 1):
        key, shard = level_keys(tokens, at, level, model.shards)
        by, bounds = packing.by_shard(shard, model.shards)
        discount = np.array([0.0, *model.discounts[level - 1]])
        add, scale = np.zeros(len(at)), np.ones(len(at))
        if level == 1:
            scale[:] = model.base_gamma
        for s in np.flatnonzero(np.diff(bounds)):
            name = files.get((level, int(s)))
            if name is None:
                continue
            own = by[bounds[s] : bounds[s + 1]]
            own = own[np.argsort(key[own])]
            q, keys, counts = key[own], _mapped(model.folder, f"{name}-key"), _mapped(model.folder, f"{name}-count")
            where, hit = _find(keys, q)
            where, mine = where[hit], own[hit]
            count = counts[where].astype(np.int64)
            if level == 1:
                known[mine] = _mapped(model.folder, f"{name}-raw")[where]
                add[mine] = (count - discount[np.minimum(count, 3)]) / model.base_total
                continue
            total, many = _context_sums(model.folder, name, keys, counts, q >> WORD_BITS)
            seen = total > 0
            scale[own[seen]] = (discount[1:] @ many[:, seen]) / total[seen]
            add[mine] = (count - discount[np.minimum(count, 3)]) / total[hit]
        p = np.maximum(add, 0.0) + scale * p
    return np.log10(p), known, n


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra columns, n_tokens, n_known, base_score, score) of each row of ``docs``; nothing is shuffled.

    base_score is that of add-half unigrams, score the model's, both log10 of the whole text's probability. Null and
    empty texts have the end alone; repeated rows give repeated results; an untrained model is uniform.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_bytes(batch.column(1))
            parts = []
            for a, b in words.slices(texts, 1 << 20):
                logs, known, n = token_scores(model, texts[a:b])
                first = np.cumsum(n) - n
                base = np.log10((known + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                parts.append((n, np.add.reduceat((known > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logs, first)))
            if parts:
                passed = [batch.column(0), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*passed, *(pa.array(np.concatenate(x)) for x in zip(*parts))], [id_col, *extra, "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"), *(F.col(c) for c in extra))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *extra))
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_corpus(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows not held out and score all of them; adds held_out and train_tokens."""
    model = train(docs.where(~held_out(id_col)), order, text_col)
    rows = score(docs, model, id_col, text_col)
    return rows.select(id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
