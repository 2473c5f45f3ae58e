"""Interaction of text filters: what each removes, repeats and loses in every order, duplicates by radix text tries.

A task judges its texts and merges equal ones in a trie, block by block: rows with a larger id than the block's least
for the text are known to be duplicates, one row a text is left. These are dealt by ranges of texts, whose bounds are
prefixes no longer than it takes to tell their neighbours apart, and inserted whole into one trie a range, which holds
the least id at each terminal. Rows then are no more than an id, a part and a mask of the filters they fail; these
meet the labels, and counts by mask give every order's figures.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of different texts that a block merges, of a range, of an Arrow batch, what a row counts beside its text, bytes
#: of a prefix (texts that agree in it are told apart by their digests), and texts drawn for each range to set bounds.
BLOCK, RANGE, BATCH, ROW, PREFIX, DRAWN = 32 << 20, 32 << 20, 4 << 20, 256, 64, 64
_UPPER, _CONTINUED, _MARKS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), [bytes([c]) for c in b"#$%&*|"]


def failures(text: bytes) -> int:
    """The filters that a text in UTF-8 fails, as bits: under 50 words; under 65 % different words; over 5 % capitals
    A-Z; a mark of #$%&*|."""
    words = text.split()  # at bytes 0x20 and 0x09 to 0x0D
    short, alike = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * len(text.translate(None, _CONTINUED))
    return short | alike << 1 | loud << 2 | any(m in text for m in _MARKS) << 3


class TextTrie:
    """A compressed trie of byte strings: one edge for each run of bytes without a branch; ``least`` has the smallest id
    inserted at each node, None where no text ends or none with an id."""

    def __init__(self):
        self.edges: dict[tuple[int, int], tuple[bytes, int]] = {}
        self.least: list = [None]
        self.held = 0

    def _node(self) -> int:
        self.least.append(None)
        return len(self.least) - 1

    def insert(self, text: bytes, who) -> int:
        """The node at which ``text`` ends."""
        node, at = 0, 0
        while at < len(text):
            edge = self.edges.get((node, text[at]))
            if edge is None:
                new = self._node()
                self.edges[node, text[at]] = text[at:], new
                self.held += len(text) - at
                node, at = new, len(text)
                continue
            label, child = edge
            k = len(label) if text.startswith(label, at) else _common(label, text, at)
            if k < len(label):
                middle = self._node()
                self.edges[node, text[at]] = label[:k], middle
                self.edges[middle, label[k]] = label[k:], child
                child = middle
            node, at = child, at + k
        if who is not None and (self.least[node] is None or who < self.least[node]):
            self.least[node] = who
        return node


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of what ``label`` and ``text`` from ``at`` on begin with in common; they differ before the label's end."""
    high = 8
    while text.startswith(label[:high], at):
        high *= 2
    low = high // 2 if high > 8 else 0
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if text.startswith(label[:middle], at) else (low, middle)
    return low


def range_key(text: bytes) -> bytes:
    """What texts are dealt by: a prefix, and a digest of the whole text where they agree in it."""
    return text if len(text) < PREFIX else text[:PREFIX] + hashlib.md5(text).digest()[:8]


def bounds(drawn: list[tuple[bytes, int]], n: int) -> list[bytes]:
    """At most ``n`` - 1 bounds that split the drawn (key, weight) evenly by weight, each the shortest prefix of a key
    that is above the key before it."""
    drawn, out, done, total = sorted(drawn), [], 0, sum(w for _, w in drawn)
    for (low, weight), (high, _) in zip(drawn, drawn[1:]):
        done += weight
        if done * n >= total * (len(out) + 1) and low < high:
            k = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            out.append(high[: k + 1])
            while done * n >= total * (len(out) + 1) and len(out) < n - 1:
                out.append(out[-1])  # one text has the weight of several ranges
    return out[: n - 1]


def _ranges(texts: DataFrame, n_rows: int, range_bytes: int) -> tuple[list[bytes], int]:
    """Bounds and number of ranges for (text). Texts are drawn to find even bounds only; every text is dealt by them."""
    least = common.shards(texts.sparkSession)
    share = min(1.0, DRAWN * max(least, n_rows * ROW // range_bytes) / max(1, n_rows))
    key = F.when(F.length("text") < PREFIX, F.col("text")).otherwise(F.concat(F.substring("text", 1, PREFIX), F.unhex(F.substring(F.md5("text"), 1, 16))))
    drawn = [(bytes(r.key), r.weight) for r in texts.sample(share, seed=0).select(key.alias("key"), (F.length("text") + ROW).cast("long").alias("weight")).collect()]
    n = max(least, int(sum(w for _, w in drawn) / share) // range_bytes + 1)
    return bounds(drawn, n), n


def _entries(rows: DataFrame, cuts: list[bytes], n: int, rules: Callable[[bytes], int], repeated: int, block: int, kind: str) -> DataFrame:
    """(doc_id, part, mask, n, range, text) of (doc_id, part, text): rows already known to be duplicates, or to be none
    as they have no id, are without text; of the rest there is one row a block for each text, least id and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, fails, texts, held, turn = TextTrie(), {}, {}, [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            out, size, least = [], 0, {}
            for who, part, node in held:
                mask = fails[node]
                if who is not None and who == trie.least[node]:
                    least[node, part] = least.get((node, part), 0) + 1
                    continue
                turn += 1
                out.append((who, part, mask | repeated * (who is not None), 1, turn % n, None))
                if len(out) >= BATCH // ROW:
                    yield _batch(out)
                    out = []
            for (node, part), times in least.items():
                text = texts[node]
                out.append((trie.least[node], part, fails[node], times, bisect.bisect_right(cuts, range_key(text)), text))
                size += len(text) + ROW
                if size >= BATCH:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

        for batch in batches:
            kinds.append(batch.schema.field(0).type)
            for who, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                node = trie.insert(text, who)
                if node not in fails:
                    fails[node], texts[node] = rules(text), text
                held.append((who, part, node))
                if trie.held + ROW * len(held) >= block:
                    yield from ended()
                    trie, fails, texts, held = TextTrie(), {}, {}, []
        yield from ended()

    kinds: list = []

    def _batch(out: list) -> pa.RecordBatch:
        ids, parts, masks, times, ranges, texts = zip(*out)
        columns = [pa.array(ids, kinds[0]), pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(times, pa.int64()), pa.array(ranges, pa.int32()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "n", "range", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, n long, range int, text binary")


def _flagged(entries: DataFrame, repeated: int, kind: str) -> DataFrame:
    """(doc_id, part, mask, n): entries dealt by their ranges, those that aren't decided yet by the trie of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, names, types = TextTrie(), [], ["doc_id", "part", "mask", "n"], None
        for batch in batches:
            types = [batch.schema.field(c).type for c in names]
            decided = batch.filter(batch.column("text").is_null()).select(names)
            if decided.num_rows:
                yield decided
            open_ = batch.filter(batch.column("text").is_valid())
            for row, text in zip(zip(*(open_.column(c).to_pylist() for c in names)), open_.column("text")):
                held.append((*row, trie.insert(text.as_py(), row[0])))
        for at in range(0, len(held), BATCH // ROW):
            who, part, mask, times, node = zip(*held[at : at + BATCH // ROW])
            mask = [m | repeated * (w > trie.least[k]) for w, m, k in zip(who, mask, node)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((who, part, mask, times), types)], names)

    return entries.mapInArrow(run, f"doc_id {kind}, part string, mask int, n long")


def masks(docs: DataFrame, rules: Callable[[bytes], int] = failures, n_rules: int = 4, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text",
          block: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """(doc_id, part, mask, n): documents with the bits of the rules they fail and, above those, of being a duplicate.

    A duplicate has the same text as a row with a smaller id, wherever that is. ``n`` rows of one id, part and text may
    be one row. A null text counts as empty, a null part as the empty string; rows without an id are no duplicates and
    make none. An empty table gives no rows, and other columns aren't looked at. A task holds one block or one range of
    texts; a text that very many rows share is one row a block at most, so its range is met once a block.
    """
    kind, repeated = docs.schema[id_col].dataType.simpleString(), 1 << n_rules
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    cuts, n = _ranges(docs.select(text.alias("text")), docs.count(), range_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    entries = _entries(rows, cuts, n, rules, repeated, block, kind)
    return _flagged(entries.repartitionById(n, F.col("range")), repeated, kind)


def counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part and mask, and how many a label (doc_id, quality, toxic) calls good
    or toxic; of several labels of an id any that says so counts."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masked.join(known, "doc_id", "left")
    told = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(told("good"), told("toxic"), F.sum("n").alias("n"))


def interactions(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of
    the filters ``names``, the first of which is bit 0 of the masks. What a filter removes depends only on the set of
    those before it, so each (filter, set) is summed once."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    steps = [("".join(order), at + 1, bit[f], sum(bit[g] for g in order[:at])) for order in permutations(names) for at, f in enumerate(order)]
    pairs = sorted({(f, before) for _, _, f, before in steps})
    rows = counted.withColumn("p", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(b).alias("before")) for f, b in pairs)))).select("*", "p.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("f")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    orders = len(steps) // len(names)
    of = lambda what, where, name: F.sum(F.when(where, F.col(what)).otherwise(F.lit(0))).cast("long").alias(name)
    first = F.expr(f"n * ({orders} div greatest(bit_count(mask), 1))").alias("first")  # of the filters it fails each comes first equally often
    sums = rows.select("*", first).groupBy("part", "f", "before").agg(
        of("n", ~fails & ~gone, "kept"), of("n", fails & ~gone, "removed"), of("n", fails & gone, "redundant"), of("n", F.col("mask") == F.col("f"), "unique_fails"),
        of("good", fails & ~gone, "good_lost"), of("toxic", fails & ~gone, "toxic_lost"), of("first", fails, "shapley"))
    plan = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")
    return sums.join(F.broadcast(plan), ["f", "before"]).drop("f", "before")  # as many rows as orders and steps


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters' interactions in each part of ``docs``; a part has all orders and steps, zeros included."""
    return interactions(counts(masks(docs), labels))
