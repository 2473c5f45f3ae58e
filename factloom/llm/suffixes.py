"""Removal of long repeats by run-length indexes.

Two equal strings of ``length`` bytes have the same smallest hashed k-gram in the same place. So each run of windows
with one smallest k-gram (an anchor) is a context, and repeats are found among the contexts of equal anchors.

Blocks of documents send each of their distinct (anchor, hash of the context) once to a shard of anchors and keep their
places themselves, in a directory row. A shard adds up the places and answers with one byte an entry: a context met
twice is repeated as a whole, and one place of each different context of an anchor goes to an index. There a run-length
index of a few thousand contexts keeps the Burrows-Wheeler runs, the suffixes sampled at their ends and the longest
matches across each end. Everywhere else the match of a place is that of the place before less one, so matching
statistics are streamed from the samples in one pass. Anchors with very many different contexts, as at the ends of a
passage that many documents share, would make one index too large: hashes of their windows are counted instead, dealt
over all shards in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing, words

GRAM = 64
PLACE_BITS = np.uint64(20)
PIECE = 1 << 19
BLOCK = 1 << 18
#: Different contexts of an anchor in one block, and in all of them, beyond which its windows are counted one by one.
MANY_IN_BLOCK, MANY = 16, 1024
#: Bytes of text a shard of anchors answers for, and contexts an index has, about.
SHARD_BYTES, INDEX_CONTEXTS = 1 << 26, 1 << 12
#: Windows a block of contexts counts at once.
BLOCK_WINDOWS = 1 << 20
#: What a shard answers for an entry, as bits: repeated as a whole, to be indexed, windows to be counted.
WHOLE, INDEXED, COUNTED = 1, 2, 4
_INVERSE = np.uint64(pow(int(words._ODD[0]), -1, 2**64))
_inverse = np.ones(1, np.uint64)
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _inverses(n: int) -> np.ndarray:
    global _inverse
    while len(_inverse) < n:
        _inverse = np.concatenate([_inverse, _inverse * (_inverse[-1:] * _INVERSE)])
    return _inverse[:n]


def anchor_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, number of windows, hash of all bytes of these windows) of each run of windows of ``data`` that have the
    same leftmost smallest k-gram, in order; a run begins where the one before ends. Long texts go in overlapping
    pieces, each of which has all the windows that begin in it."""
    gram = min(GRAM, length)
    w, out = length - gram + 1, []
    for at in range(0, len(data) - length + 1, PIECE):
        buf = np.frombuffer(data, np.uint8)[at : at + PIECE + length - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words._PLAIN[buf] * words.powers(len(buf)), dtype=np.uint64)])
        back = _inverses(len(buf))
        h = words.mix((total[gram:] - total[:-gram]) * back[: len(buf) - gram + 1])
        h = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - w + 1
        grid = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        before = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(before[:n], ahead[w - 1 : w - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        windows = np.diff(np.append(first, n))
        size = windows + length - 1
        content = words.mix((total[first + size] - total[first]) * back[first] + size.astype(np.uint64) * words._ODD[3])
        out.append((least[first] >> PLACE_BITS, windows, (content >> np.uint64(16)) | np.uint64(1)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass(frozen=True)
class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform, the places of the suffixes on both sides of each boundary between runs,
    and how far those two match. Its size is the number of runs, whatever the text's length."""

    heads: np.ndarray
    lengths: np.ndarray
    above: np.ndarray
    below: np.ndarray
    match: np.ndarray

    def matching_statistics(self, n: int) -> np.ndarray:
        """The longest match of each of ``n`` places with another one, streamed from the samples."""
        reach = np.zeros(n, np.int64)
        np.maximum.at(reach, self.above, self.match + self.above)
        np.maximum.at(reach, self.below, self.match + self.below)
        return np.maximum.accumulate(reach) - np.arange(n)


def run_length_index(contexts: list[bytes]) -> RunLengthIndex:
    """The index of the joined ``contexts``, each followed by a separator of its own. Suffixes are sorted by doubling;
    only their order at the runs' ends is kept."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    own = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    left = (ends[own] - np.arange(n)).astype(np.int32)  # bytes before the separator
    eight = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + n]
    # bytes beyond the separator don't count, and suffixes that reach it are told apart by it
    beyond = np.maximum(0, 7 - left).astype(np.uint64)
    key = eight >> (beyond * np.uint64(8)) << (beyond * np.uint64(8))
    near = np.where(left < 8, own + 1, 0)
    order = np.lexsort((near, key))
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], (key[order][1:] != key[order][:-1]) | (near[order][1:] != near[order][:-1])]))
    h = 8
    while rank[order[-1]] < n - 1 and h <= int(sizes.max()):
        after = np.concatenate([rank[h:], np.full(min(h, n), -1, np.int32)])[:n] + 1
        pair = rank.astype(np.int64) * (n + 2) + after
        order = np.argsort(pair)
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate([[False], pair[order][1:] != pair[order][:-1]]))
        h *= 2
    code = text.astype(np.int32)
    code[ends] = 256 + np.arange(len(contexts))
    before = code[order - 1]
    edge = np.flatnonzero(before[1:] != before[:-1])  # a run ends at edge and the next begins at edge + 1
    heads, lengths = before[np.append(edge, n - 1)], np.diff(np.concatenate([[-1], edge, [n - 1]]))
    above, below = order[edge], order[edge + 1]
    most = np.minimum(left[above], left[below])
    match, open_ = np.zeros(len(edge), np.int64), np.flatnonzero(most > 0)
    eight = np.append(eight, np.uint64(0))
    while len(open_):
        i, j = np.minimum(above[open_] + match[open_], n), np.minimum(below[open_] + match[open_], n)
        differ = eight[i] ^ eight[j]
        same = np.full(len(open_), 8)
        for k in range(8):
            same[(differ >> np.uint64(56 - 8 * k)) & np.uint64(255) > 0] = np.minimum(same, k)[(differ >> np.uint64(56 - 8 * k)) & np.uint64(255) > 0]
        match[open_] += same
        open_ = open_[(same == 8) & (match[open_] < most[open_])]
    return RunLengthIndex(heads, lengths, above, below, np.minimum(match, most))


def repeated_windows(contexts: list[bytes], length: int) -> np.ndarray:
    """For each byte of the joined ``contexts`` (each followed by one separator), whether a string of ``length`` bytes
    begins there that begins elsewhere in them too."""
    return run_length_index(contexts).matching_statistics(sum(map(len, contexts)) + len(contexts)) >= length


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered by strings of ``length`` bytes at ascending ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


_SENT = {"shard": pa.int32(), "block": pa.int64(), "anchors": pa.binary(), "contents": pa.binary(), "counts": pa.binary(), "shas": pa.binary(), "runs": pa.binary(), "windows": pa.binary(), "entries": pa.binary()}
_ANSWERED = {"shard": pa.int32(), "block": pa.int64(), "flags": pa.binary(), "anchors": pa.binary(), "shas": pa.binary(), "runs": pa.binary(), "windows": pa.binary(), "entries": pa.binary()}
_DIRECTORY = ("shas", "runs", "windows", "entries")


def _sql(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {'int' if t == pa.int32() else 'long' if t == pa.int64() else 'binary'}" for n, t in kinds.items())


def _entries(anchor: np.ndarray, content: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which distinct (shard, anchor, content) each run has, in their order; a run of each, and how many it has."""
    order = np.lexsort((content, anchor, shard))
    a, c, s = anchor[order], content[order], shard[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return entry, order[starts], np.diff(np.append(starts, len(a)))


def _marked(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """(sha, full, spans, runs) of each row of ``docs`` (text) with repeated anchors: spans repeated as a whole,
    whether these are all of it, and the runs (first, windows, anchor, many) to be compared with others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            per_doc = np.array([len(r[0]) for _, r in held])
            anchor, windows, content = (np.concatenate([r[k] for _, r in held]) for k in range(3))
            shard = (words.mix(anchor) % np.uint64(shards)).astype(np.int32)
            entry, pick, count = _entries(anchor, content, shard)
            first = np.flatnonzero(np.diff(anchor[pick], prepend=~anchor[pick[:1]]))
            different = np.diff(np.append(first, len(pick)))
            if (many := np.repeat(different, different) > MANY_IN_BLOCK).any():
                content[(many & (count == 1))[entry]] = 0  # so many that they are known to be compared by windows
                entry, pick, count = _entries(anchor, content, shard)
            shas = b"".join(s for s, _ in held)
            task = TaskContext.get()
            block = int.from_bytes(hashlib.sha256(shas + f"{task.partitionId() if task else 0}-{number}".encode()).digest()[:8], "big") >> 1
            bounds = np.searchsorted(shard[pick], np.arange(shards + 1))
            rows = [(s, block, packing.pack_sorted(anchor[p]), packing.pack(content[p]), packing.pack(c), None, None, None, None)
                    for s in np.flatnonzero(np.diff(bounds)).tolist() for p, c in ((pick[bounds[s] : bounds[s + 1]], count[bounds[s] : bounds[s + 1]]),)]
            rows.append((block % shards, block, None, None, None, shas, packing.pack(per_doc), packing.pack(windows), packing.pack(entry)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT.values())], list(_SENT))

        for batch in batches:
            for data in words.as_bytes(batch.column(0)):
                if len(data) >= length:
                    held.append((hashlib.sha256(data).digest(), anchor_runs(data, length)))
                    n += len(held[-1][1][0])
                    if n >= BLOCK:
                        yield flush()
                        n, number = 0, number + 1
        if held:
            yield flush()

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["shard"], r["block"], None, None, *(r[c] for c in _DIRECTORY)) for r in rows if r["shas"] is not None]
        rows = sorted((r for r in rows if r["shas"] is None), key=lambda r: r["block"])
        if rows:
            anchors = [packing.unpack_sorted(r["anchors"]) for r in rows]
            sizes = np.array([len(a) for a in anchors])
            anchor, content, count = np.concatenate(anchors), *(np.concatenate([packing.unpack(r[c]) for r in rows]) for c in ("contents", "counts"))
            order = np.lexsort((content, anchor))
            a, c = anchor[order], content[order]
            new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
            new = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
            starts = np.flatnonzero(new)
            places = np.add.reduceat(count[order].astype(np.int64), starts)
            group = np.cumsum(new) - 1
            anchor_of = np.cumsum(new_anchor)[starts] - 1
            different = np.bincount(anchor_of)
            many = (different > MANY) | (np.bincount(anchor_of, c[starts] == 0) > 0)
            flag = np.where(places > 1, WHOLE, 0) + np.where(different[anchor_of] > 1, np.where(many[anchor_of], COUNTED, INDEXED), 0)
            flag = np.where(c[starts] == 0, COUNTED, flag)[group]
            flag[(flag & WHOLE > 0) & ~new] = WHOLE  # one place of each context is enough for comparing
            flags = np.empty(len(a), np.uint8)
            flags[order] = flag
            at = np.cumsum(sizes) - sizes
            for r, i, n in zip(rows, at.tolist(), sizes.tolist()):
                f = flags[i : i + n]
                out.append((r["shard"], r["block"], f.tobytes(), packing.pack_sorted(anchor[i : i + n][f >= INDEXED]), *[None] * 4))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _ANSWERED.values())], list(_ANSWERED))

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        about = next(r for r in rows if r["shas"] is not None)
        answers = sorted((r for r in rows if r["shas"] is None), key=lambda r: r["shard"])
        flags = np.frombuffer(b"".join(r["flags"] for r in answers), np.uint8)
        anchors = np.zeros(len(flags), np.uint64)
        anchors[flags >= INDEXED] = np.concatenate([packing.unpack_sorted(r["anchors"]) for r in answers])
        per_doc, windows, entry = (packing.unpack(about[c]).astype(np.int64) for c in _DIRECTORY[1:])
        if entry.max() + 1 != len(flags):
            raise RuntimeError("a block of documents was not answered as it was sent")
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        start = np.cumsum(windows) - windows
        first = start - np.repeat(start[np.cumsum(per_doc) - per_doc], per_doc)
        flag = flags[entry]
        leads = np.zeros(len(entry), bool)
        leads[np.unique(entry, return_index=True)[1]] = True
        whole = flag & WHOLE > 0
        compared = (flag >= INDEXED) & (leads | ~whole)
        joined = np.zeros(len(whole), bool)  # a repeated run right after another one of the same text
        joined[1:] = whole[1:] & whole[:-1] & (doc[1:] == doc[:-1])
        begins = np.flatnonzero(whole & ~joined)
        ends = np.flatnonzero(whole & ~np.append(joined[1:], False))
        full = np.bincount(doc, whole, len(per_doc)) == per_doc
        touched = np.bincount(doc, whole | compared, len(per_doc)) > 0

        def lists(where: np.ndarray, *fields: tuple[str, np.ndarray]) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[where], minlength=len(per_doc)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for _, v in fields], [k for k, _ in fields]))

        spans = lists(begins, ("a", first[begins]), ("b", first[ends] + windows[ends] + length - 1))
        at = np.flatnonzero(compared)
        runs = lists(at, ("first", first[at]), ("windows", windows[at]), ("anchor", anchors[entry[at]].view(np.int64)), ("many", flag[at] & COUNTED > 0))
        shas = pa.array([about["shas"][32 * k : 32 * k + 32] for k in range(len(per_doc))], pa.binary())
        return pa.table([shas, pa.array(full), spans, runs], ["sha", "full", "spans", "runs"]).filter(pa.array(touched))

    sent = docs.select(F.col("text").cast("binary")).mapInArrow(send, _sql(_SENT))
    answered = sent.groupBy("shard").applyInArrow(answer, _sql(_ANSWERED))
    return answered.groupBy("block").applyInArrow(gather, "sha binary, full boolean, spans array<struct<a:long,b:long>>, runs array<struct<first:long,windows:long,anchor:long,many:boolean>>")


def _indexed(contexts: DataFrame, length: int) -> DataFrame:
    """(sha, spans) from the (shard, sha, first, context) of whole indexes."""

    def mark(table: pa.Table) -> pa.Table:
        contexts = table["context"].to_pylist()
        flags, at, found = repeated_windows(contexts, length), 0, []
        for context, first in zip(contexts, table["first"].to_pylist()):
            found.append([{"a": first + a, "b": first + b} for a, b in _spans(np.flatnonzero(flags[at : at + len(context) - length + 1]), length)])
            at += len(context) + 1
        return pa.table({"sha": table["sha"], "spans": pa.array(found, _SPANS)}).filter(pa.array([bool(s) for s in found], pa.bool_()))

    return contexts.groupBy("shard").applyInArrow(mark, "sha binary, spans array<struct<a:long,b:long>>")


def _counted(contexts: DataFrame, length: int, shards: int) -> DataFrame:
    """(sha, spans) from the (sha, first, anchor, context) of anchors with very many contexts: hashes of windows are
    counted, each once a block and shard, so one met everywhere costs a number a block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            keys, entry, count = np.unique(np.concatenate([k for _, _, k in held]), return_inverse=True, return_counts=True)
            bounds = np.searchsorted(((keys >> np.uint64(44)) * np.uint64(shards)) >> np.uint64(20), np.arange(shards + 1, dtype=np.uint64))
            shas, task = b"".join(s for s, _, _ in held), TaskContext.get()
            block = int.from_bytes(hashlib.sha256(shas + f"{task.partitionId() if task else 0}-{number}".encode()).digest()[:8], "big") >> 1
            rows = [(s, block, packing.pack_sorted(keys[own]), packing.pack(count[own]), *[None] * 4) for s in np.flatnonzero(np.diff(bounds)).tolist() for own in (slice(bounds[s], bounds[s + 1]),)]
            rows.append((block % shards, block, None, None, shas, packing.pack(np.array([len(k) for _, _, k in held])), packing.pack(np.array([f for _, f, _ in held])), packing.pack(entry)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

        for batch in batches:
            for sha, first, anchor, context in zip(*(c.to_pylist() for c in batch.columns)):
                buf = np.frombuffer(context, np.uint8)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words._PLAIN[buf] * words.powers(len(buf)), dtype=np.uint64)])
                salt = np.uint64(anchor % 2**64)
                held.append((sha, first, words.mix(words.mix((total[length:] - total[:-length]) * _inverses(len(buf))[: len(buf) - length + 1]) + salt)))
                n += len(held[-1][2])
                if n >= BLOCK_WINDOWS:
                    yield flush()
                    n, number = 0, number + 1
        if held:
            yield flush()

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["shard"], r["block"], None, None, *(r[c] for c in directory)) for r in rows if r["shas"] is not None]
        rows = [r for r in rows if r["shas"] is None]
        if rows:
            keys = [packing.unpack_sorted(r["keys"]) for r in rows]
            distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
            twice = np.bincount(group, np.concatenate([packing.unpack(r["counts"]) for r in rows]), len(distinct))[group] > 1
            at = np.cumsum([0, *map(len, keys)])
            out += [(r["shard"], r["block"], np.packbits(twice[i : i + len(k)]).tobytes(), packing.pack(np.array([len(k)])), *[None] * 4) for r, k, i in zip(rows, keys, at.tolist())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        about = next(r for r in rows if r["shas"] is not None)
        answers = sorted((r for r in rows if r["shas"] is None), key=lambda r: r["shard"])
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["keys"], np.uint8), count=int(packing.unpack(r["counts"])[0])) for r in answers]).astype(bool)
        windows, firsts, entry = (packing.unpack(about[c]).astype(np.int64) for c in directory[1:])
        if entry.max() + 1 != len(twice):
            raise RuntimeError("a block of contexts was not answered as it was sent")
        flags, at, found = twice[entry], 0, []
        for first, n in zip(firsts.tolist(), windows.tolist()):
            found.append([{"a": first + a, "b": first + b} for a, b in _spans(np.flatnonzero(flags[at : at + n]), length)])
            at += n
        shas = pa.array([about["shas"][32 * k : 32 * k + 32] for k in range(len(firsts))], pa.binary())
        return pa.table({"sha": shas, "spans": pa.array(found, _SPANS)}).filter(pa.array([bool(s) for s in found], pa.bool_()))

    directory = ("shas", "windows", "firsts", "entries")
    kinds = {"shard": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "counts": pa.binary()} | dict.fromkeys(directory, pa.binary())
    sent = contexts.select("sha", "first", "anchor", "context").mapInArrow(send, _sql(kinds))
    answered = sent.groupBy("shard").applyInArrow(answer, _sql(kinds))
    return answered.groupBy("block").applyInArrow(gather, "sha binary, spans array<struct<a:long,b:long>>")


def _cut(affected: DataFrame, keep_text: bool) -> DataFrame:
    """(sha, n_removed, n_spans, kept_sha256, kept) of (sha, text, spans)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(words.as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, [s["a"] for s in spans], 1)
                np.add.at(edges, [s["b"] for s in spans], -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string())))], ["sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    return affected.select("sha", F.col("text").cast("binary"), "spans").mapInArrow(cut, "sha binary, n_removed long, n_spans long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row, and with ``keep_text`` its remaining text as kept
    (null where nothing is removed; a character that a cut goes through is dropped) and the sha of its text.

    A byte goes if a string of ``length`` bytes that covers it also begins anywhere else in the texts of ``docs``, in
    the same text included; matches don't cross texts, and all are judged on the input. Null texts count as empty;
    shorter texts stay; equal rows are copies of each other; an empty table gives an empty result; other columns are
    not looked at. Texts are told apart by their whole SHA-256, never by their ids: ids may be null or stand for
    several texts. Joins that move texts are always sorted ones, so that work grows evenly with the input.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    info = common.written(docs.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "texts")
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    marked = common.written(_marked(docs, length, max(common.shards(docs.sparkSession), total // SHARD_BYTES)), "marked")
    # a text is wanted to be cut, or to lend an index its contexts; one that occurs again is repeated as a whole
    runs = marked.select("sha", F.explode("runs").alias("r")).distinct().groupBy("sha").agg(F.collect_list("r").alias("runs"))
    wanted = marked.groupBy("sha").agg((F.max("full") | (F.count(F.lit(1)) > 1)).alias("full"), F.first("spans").alias("spans")).join(runs, "sha", "left")
    wanted = common.written(wanted, "wanted")
    full = wanted.where("full").select("sha")
    wanted = wanted.where("not full or runs is not null").withColumn("runs", F.coalesce("runs", F.expr("cast(array() as array<struct<first:long,windows:long,anchor:long,many:boolean>>)")))
    # of copies the one with the smallest hashed id is fetched
    place = info.join(wanted.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.min(F.xxhash64(id_col)).alias("of"))
    wanted = wanted.join(place, "sha").withColumnRenamed("sha", "__sha")
    texts = docs.select("sha", F.xxhash64(id_col).alias("__of"), "text").hint("merge")
    affected = texts.join(wanted, (F.col("sha") == F.col("__sha")) & (F.col("__of") == F.col("of"))).dropDuplicates(["sha", "__of"])
    affected = common.written(affected.select("sha", "text", "full", "spans", "runs"), "affected")
    runs = affected.select("sha", F.col("text").cast("binary").alias("data"), F.explode("runs").alias("r"))
    context = F.substring("data", (F.col("r.first") + 1).cast("int"), (F.col("r.windows") + F.lit(length - 1)).cast("int"))
    contexts = runs.select("sha", "r.first", "r.anchor", "r.many", context.alias("context"))
    n_indexed = affected.agg(F.sum(F.size(F.filter("runs", lambda r: ~r["many"])))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(common.shards(docs.sparkSession), n_indexed // INDEX_CONTEXTS)))
    spans = _indexed(contexts.where("not many").select(shard.alias("shard"), "sha", "first", "context"), length)
    spans = spans.union(_counted(contexts.where("many"), length, common.shards(docs.sparkSession))).groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("found"))
    cut = affected.where("not full").select("sha", "text", "spans").hint("merge").join(spans, "sha", "left")
    cut = cut.select("sha", "text", F.concat("spans", F.coalesce("found", F.expr("cast(array() as array<struct<a:long,b:long>>)"))).alias("spans")).where("size(spans) > 0")
    nothing = F.sha2(F.lit(b""), 256)
    done = full.select("sha", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256"), F.lit("").alias("kept"), F.lit(True).alias("all"))
    done = common.written(_cut(cut, keep_text).withColumn("all", F.lit(False)).unionByName(done).withColumnRenamed("sha", "__sha"), "cut")
    rows = info.join(done, info.sha == F.col("__sha"), "left")
    removed = F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    rows = rows.select(id_col, "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), "kept", "sha")
    return rows if keep_text else rows.drop("kept", "sha")


def cleaned(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with repeats cut out of their texts and n_chars set anew; a text with nothing left goes."""
    result = without_repeats(docs, length, keep_text=True).where("n_removed > 0").select(F.col("sha").alias("__sha"), F.col("kept").alias("__kept"), F.lit(True).alias("__cut")).dropDuplicates(["__sha"])
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.join(result, sha == F.col("__sha"), "left").withColumn("text", F.when(F.col("__cut"), F.coalesce("__kept", F.lit(""))).otherwise(F.col("text")))
    rows = rows.where("__cut is null or length(text) > 0")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
