"""Exact n-gram Jaccard join by rare-first prefix filtering, and the classes its links make.

Documents with equal shingle sets are one set from the start. Shards of hashed shingles count in how many sets each
occurs and send back those of two sets or more; a shingle of one set alone can't match, so it ranks first and takes
up prefix places without a posting. Shingles of a large share of all texts rank last without being counted, and what
would be counted is dealt by shingle and set. A set posts the rest of its prefix. Sets that share a posting are candidates
while the length, positional and suffix filters allow enough overlap, and are verified on their sets, once a pair.
Candidates first meet one leader a posting; sets linked by then needn't meet again, so a large group of near copies
costs its size and not its square, and what is left apart meets in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, packing, words

BLOCK = 1 << 20
#: Cuts of the hash range for the suffix filter, and rounds in which candidates meet leaders only.
CUTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
LEADER_ROUNDS = 2
#: Earlier places that a posting names, so that sets which share one of them too aren't paired again.
PRIOR = 8
#: Words of 64 parity cells by which the suffix filter compares what follows a common posting.
MARKS = 4
#: A shingle is frequent if a 64th of the texts of some blocks have it, and these are a 64th of all texts, and so many, at least.
SHARE, FREQUENT = 64, 4096
#: Ids of candidate documents are broadcast up to this number (24 bytes each, keys of their texts with them) and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000


def least_overlap(n, percent: int):
    """Shingles a set of ``n`` must share with any set linked to it."""
    return (percent * n + 99) // 100


def _fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set, whatever its order; 0 for an empty one."""
    out = []
    for c in (words._ODD[6], words._ODD[7]):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(values ^ c), dtype=np.uint64)])
        end = np.cumsum(counts)
        out.append((total[end] - total[end - counts]).view(np.int64))
    return out[0], out[1]


def fingerprints(bits: int = 64, shared: tuple[int, ...] = ()):
    """How sets are named: by ``bits`` of their first fingerprint, or where that is among ``shared`` by their second."""
    low = np.uint64((1 << bits) - 1)

    def name(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, fp2 = _fingerprints(values, counts)
        fp = (fp.view(np.uint64) & low).view(np.int64)
        return np.where(np.isin(fp, np.array(shared, np.int64)), fp2, fp) if shared else fp, fp2

    return name


def shared_fingerprints(info: DataFrame) -> tuple[int, ...]:
    """First fingerprints that sets with different second ones have. Of n sets about n^2 / 2^65 do (three of 10^10, some
    27000 of 10^12), so they can be sent to all tasks."""
    seen = info.where("n > 0").groupBy("fp").agg(F.min("fp2").alias("low"), F.max("fp2").alias("high"))
    return tuple(r.fp for r in seen.where("low <> high").select("fp").collect())


def shingle_sets(docs: DataFrame, n_words: int, id_col: str = "doc_id", text_col: str = "text", with_set: bool = False, with_key: bool = False, with_common: bool = False, name=_fingerprints) -> DataFrame:
    """(id, n, fp, fp2): size and fingerprints of each row's shingle set, and with ``with_set`` its sorted hashes, with
    ``with_key`` the ``text_key`` of its text. With ``with_common`` the last row of each block has in ``common`` the
    hashes of the shingles that a 64th of the block's texts have (two at least) and their numbers of texts."""

    def frequent(sets: list[np.ndarray], n_texts: int) -> dict[str, list[int]]:
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        many = times >= max(2, n_texts / SHARE)
        return {"shingles": values[many].view(np.int64).tolist(), "texts": times[many].tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not with_common:
            yield from sets(batches, lambda values, counts: None)
            return
        held, n_texts, waiting = [], 0, None

        def gather(values: np.ndarray, counts: np.ndarray) -> None:
            nonlocal n_texts
            held.append(values)
            n_texts += int((counts > 0).sum())

        def ended(batch: pa.RecordBatch, found: dict[str, list[int]] | None) -> pa.RecordBatch:
            column = pa.array([None] * (batch.num_rows - 1) + [found], pa.struct([("shingles", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))]))
            return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "common"])

        for batch in sets(batches, gather):
            if waiting is not None:
                yield ended(waiting, None)
            waiting = batch
            if sum(map(len, held)) >= BLOCK:
                yield ended(waiting, frequent(held, n_texts))
                waiting, n_texts = None, 0
                held.clear()
        if waiting is not None:
            yield ended(waiting, frequent(held, n_texts))

    def sets(batches: Iterator[pa.RecordBatch], also) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_bytes(batch.column(1))
            for a, b in words.slices(texts):
                values, counts = words.shingle_sets(texts[a:b], n_words)
                also(values, counts)
                fp, fp2 = name(values, counts)
                out = [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(fp), pa.array(fp2)]
                if with_set:
                    first = np.cumsum(counts) - counts
                    out.append(pa.array([values[i : i + c].tobytes() for i, c in zip(first, counts)], pa.binary()))
                if with_key:
                    out.append(batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(out, [id_col, "n", "fp", "fp2", *["hashes"] * with_set, *["key"] * with_key])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n long, fp long, fp2 long" + ", hashes binary" * with_set + ", key long" * with_key + ", common struct<shingles:array<long>,texts:array<long>>" * with_common
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"), *[text_key(text_col)] * with_key).mapInArrow(run, schema)


def text_key(text_col: str) -> Column:
    """A hash by which a text is fetched again, as ids may be null or stand for several texts."""
    return F.xxhash64(F.col(text_col).cast("string"))


def frequent_shingles(info: DataFrame, n_texts: int) -> np.ndarray:
    """Hashes of shingles that a 64th of ``n_texts`` texts have by the blocks' own counts. A shingle of a 32nd of all
    texts is among them where blocks have 128 texts or more; they are 64 times a text's mean number of shingles at most, however
    many texts there are, so they can be sent to all tasks."""
    pairs = info.where("common is not null").select(F.explode(F.arrays_zip("common.shingles", "common.texts")).alias("p"))
    least = max(FREQUENT, -(-n_texts // SHARE))
    found = pairs.groupBy(F.col("p.shingles").alias("shingle")).agg(F.sum("p.texts").alias("texts")).where(F.col("texts") >= least)
    return np.sort(np.array([r.shingle for r in found.select("shingle").collect()], np.int64).view(np.uint64))


def _postings(docs: DataFrame, n_words: int, percent: int, total: int, text_col: str, frequent: np.ndarray, name=_fingerprints) -> DataFrame:
    """(token, fp, n, pos, prior, marks): the prefix places of each set that other sets have too. Shingles that no
    other set has take the first places of a set, ``frequent`` ones the last; ``prior`` are up to PRIOR tokens just before this one, ``marks`` the
    parities of the hashed tokens after it in 64 * MARKS cells."""
    spark = docs.sparkSession
    shards = max(common.shards(spark), total >> 20)
    # ranks need counts of shingles only up to rare collisions, so as many bits do as keep those rare
    drop = np.uint64(64 - min(64, max(32, int(total).bit_length() + 12)))
    frequent, last = np.unique(frequent >> drop), np.uint64(max(1, int(total)))

    def is_frequent(values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(frequent, values)
        return frequent[np.minimum(at, len(frequent) - 1)] == values if len(frequent) else np.zeros(len(values), bool)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush():
            counts = np.concatenate([c for _, c in held])
            values = np.concatenate([v for v, _ in held])
            fp, _ = name(values, counts)
            owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
            order = np.argsort(values)
            values, owner = values[order] >> drop, owner[order]
            top = np.uint64(64) - drop
            shard = ((values >> (top - np.uint64(20))) * np.uint64(shards)) >> np.uint64(20)
            if len(at := np.flatnonzero(is_frequent(values))):
                shard[at] = words.mix(words.mix(values[at]) ^ fp.view(np.uint64)[owner[at]]) % np.uint64(shards)
            by, bounds = packing.by_shard(shard, shards)
            rows = []
            for s in np.flatnonzero(np.diff(bounds)):
                own = by[bounds[s] : bounds[s + 1]]
                present, local = np.unique(owner[own], return_inverse=True)
                rows.append((int(s), packing.pack_sorted(values[own]), packing.pack(local), fp[present].tobytes(), packing.pack(counts[present])))
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["shard", "tokens", "owners", "fps", "sizes"])

        n = 0
        for batch in batches:
            texts = words.as_bytes(batch.column(0))
            for a, b in words.slices(texts):
                held.append(words.shingle_sets(texts[a:b], n_words))
                n += len(held[-1][0])
                if n >= BLOCK:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        token, fp, size = [], [], []
        for t, o, f, c in zip(*(table[x].to_pylist() for x in ("tokens", "owners", "fps", "sizes"))):
            local = packing.unpack(o).astype(np.int64)
            token.append(packing.unpack_sorted(t))
            fp.append(np.frombuffer(f, np.int64)[local])
            size.append(packing.unpack(c)[local])
        token, fp, size = (np.concatenate(x) for x in (token, fp, size))
        order = np.lexsort((fp, token))
        token, fp, size = token[order], fp[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        token, fp, size = token[new], fp[new], size[new]
        starts = np.flatnonzero(np.diff(token, prepend=~token[:1]))
        df = np.diff(np.append(starts, len(token)))
        df = np.where(is_frequent(token), last, np.repeat(df, df).astype(np.uint64))
        token, fp, size, df = (x[df > 1] for x in (token, fp, size, df))
        to = (words.mix(fp.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        by, bounds = packing.by_shard(to, shards)
        rows = [(int(s), fp[own].tobytes(), packing.pack(size[own]), packing.pack(df[own]), packing.pack(token[own]))
                for s in np.flatnonzero(np.diff(bounds)) for own in (by[bounds[s] : bounds[s + 1]],)]
        cols = zip(*rows) if rows else ([],) * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 4))], ["to", "fps", "sizes", "dfs", "tokens"])

    def choose(table: pa.Table) -> pa.Table:
        fp = np.concatenate([np.frombuffer(x, np.int64) for x in table["fps"].to_pylist()])
        n, df, token = (np.concatenate([packing.unpack(x) for x in table[c].to_pylist()]) for c in ("sizes", "dfs", "tokens"))
        order = np.lexsort((token, df, fp))
        fp, n, token = fp[order], n[order].astype(np.int64), token[order]
        starts = np.flatnonzero(np.diff(fp, prepend=~fp[:1]))
        k = np.diff(np.append(starts, len(fp)))
        alone = n - np.repeat(k, k)
        pos = np.arange(len(fp)) - np.repeat(starts, k) + alone
        at = np.flatnonzero(pos <= n - least_overlap(n, percent))
        earlier = np.minimum((pos - alone)[at], PRIOR)
        ends = np.cumsum(earlier)
        prior = token[np.repeat(at - ends, earlier) + np.arange(earlier.sum())]
        prior = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(prior.view(np.int64)))
        cell = words.mix(token)
        odd = np.zeros((len(token), MARKS), np.uint64)
        odd[np.arange(len(token)), (cell % np.uint64(MARKS)).astype(np.int64)] = np.uint64(1) << (cell >> np.uint64(58))
        odd = np.bitwise_xor.accumulate(odd)
        last = np.repeat(starts + k - 1, k)
        marks = pa.FixedSizeListArray.from_arrays(pa.array((odd[last[at]] ^ odd[at]).view(np.int64).ravel()), MARKS).cast(pa.list_(pa.int64()))
        return pa.table([pa.array(token[at].view(np.int64)), *(pa.array(x[at]) for x in (fp, n, pos)), prior, marks], ["token", "fp", "n", "pos", "prior", "marks"])

    sent = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(send, "shard int, tokens binary, owners binary, fps binary, sizes binary")
    back = sent.groupBy("shard").applyInArrow(count, "to int, fps binary, sizes binary, dfs binary, tokens binary")
    return back.groupBy("to").applyInArrow(choose, "token long, fp long, n long, pos long, prior array<long>, marks array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of each of the distinct pairs (a, b), from their whole sets."""
    one = sets.select("fp", "hashes")
    rows = pairs.join(one.withColumnsRenamed({"fp": "a", "hashes": "x"}), "a").join(one.withColumnsRenamed({"fp": "b", "hashes": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = percent * (len(x) + len(y))
                # suffix filter: in each range of hashes they share no more than the smaller part
                parts = [np.diff(np.searchsorted(v, CUTS), prepend=0, append=len(v)) for v in (x, y)]
                if (100 + percent) * int(np.minimum(*parts).sum()) < both:
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                linked.append((100 + percent) * int((x[at] == y).sum()) >= both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the smallest node reachable, by alternating large and small
    stars. Each round is two group-bys and is written, so a hub of any size is only ever a minimum."""
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        new = common.written(small, "edges")
        n, changed = edges.count(), new.exceptAll(edges).limit(1).count()
        if not changed and new.count() == n:
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _labelled(postings: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return postings.withColumn("c", F.col("fp"))
    return postings.join(classes, postings.fp == classes.node, "left").select(*postings.columns, F.coalesce("component", "fp").alias("c"))


#: Shingles that a set has after a place of it.
AFTER = "n - pos - 1"


def _side(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("small", "large", "after", "marks")}


def _may_link(percent: int, x: Column | dict[str, Column], y: Column | dict[str, Column]) -> Column:
    """Length and positional filter of two rows that share a posting, from least and most sizes and the shingles after
    it. Two sets share nothing before their first common posting, so linked ones pass there at least."""
    most = 1 + F.least(x["after"], y["after"])
    sizes = (percent * x["small"] <= 100 * y["large"]) & (percent * y["small"] <= 100 * x["large"])
    return sizes & (percent * (x["small"] + y["small"]) <= (100 + percent) * most)


def _suffix_fits(percent: int, x: Column | dict[str, Column], y: Column | dict[str, Column]) -> Column:
    """Suffix filter of two sets at their first common posting: they differ after it in as many shingles at least as
    cells of their marks differ."""
    apart = sum(F.bit_count(x["marks"][k].bitwiseXOR(y["marks"][k])) for k in range(MARKS))
    return 2 * percent * (x["small"] + y["small"]) <= (100 + percent) * (2 + x["after"] + y["after"] - apart)


def _leader_pairs(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each posting's leader of this turn with the sets of other classes that share the posting."""
    rows = postings.select("token", F.struct("fp", "c", F.col("n").alias("small"), F.col("n").alias("large"), F.expr(AFTER).alias("after"), "marks").alias("x"))
    # first the set with least before the place, which is nearest to what all have in common, then any
    order = F.struct((F.col("x.small") - F.col("x.after") if turn == 0 else F.lit(0)).alias("before"), F.xxhash64("x.fp", "token", F.lit(turn)).alias("hash"))
    leaders = rows.groupBy("token").agg(F.min_by("x", order).alias("l"), (F.min("x.c") < F.max("x.c")).alias("mixed")).where("mixed").drop("mixed")
    met = rows.join(leaders, "token").where("x.c <> l.c").where(_may_link(percent, _side("x"), _side("l")) & _suffix_fits(percent, _side("x"), _side("l")))
    return met.select(F.least("x.fp", "l.fp").alias("a"), F.greatest("x.fp", "l.fp").alias("b")).distinct()


def _apart_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of different classes that share a posting and pass the length and positional filters.

    A pair that also shares a token just before has met there, so it is left out here: its first common posting names
    none, and there it is met. Members of a class meet other classes in lists of a 64th, so that no pair within a
    class is ever formed; two lists are met unless the filters exclude all of their members.
    """
    mixed = postings.groupBy("token").agg((F.min("c") < F.max("c")).alias("mixed")).where("mixed").select("token")
    both = F.reduce(F.collect_list("prior"), F.first("prior"), F.array_intersect)
    lists = postings.join(mixed, "token", "left_semi").groupBy("token", "c", F.pmod("fp", F.lit(64)).alias("part")).agg(
        F.collect_list(F.struct("fp", F.col("n").alias("small"), F.col("n").alias("large"), F.expr(AFTER).alias("after"), "prior", "marks")).alias("m"), both.alias("prior"), F.min("n").alias("small"), F.max("n").alias("large"), F.max(F.expr(AFTER)).alias("after"))
    met = lists.alias("x").join(lists.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.c") < F.col("y.c")) & _may_link(percent, _side("x"), _side("y")) & ~F.arrays_overlap("x.prior", "y.prior"))
    fits = lambda y: _may_link(percent, _side("x"), y) & _suffix_fits(percent, _side("x"), y) & ~F.arrays_overlap(F.col("x.prior"), y["prior"])
    rows = met.select(F.explode("x.m").alias("x"), F.col("y.m").alias("m")).select("x", F.explode(F.filter("m", fits)).alias("y"))
    return rows.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of each row: documents link when 100 * intersection >= percent * union of their
    ``n_words`` shingle sets, and component_id is the smallest id reachable.

    Texts without words (and nulls) have no shingles and stand alone; a shorter text has its whole sequence as its one
    shingle; equal rows are one set; null ids get the component of their set. Sets are held as 64-bit hashes of shingles and told apart by two
    fingerprints: named by ``bits`` of the first, and by the second where two different sets have one name.
    """
    info, named = _components(docs, n_words, percent, id_col, text_col, bits)
    rows = info.join(named, (info.fp == F.col("__fp")) & (info.n > 0), "left")
    return rows.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"))


def _components(docs: DataFrame, n_words: int, percent: int, id_col: str, text_col: str, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (id, n, fp, key), and (__fp, component, component_id) of each set."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    info = common.written(shingle_sets(docs, n_words, id_col, text_col, with_key=True, with_common=True, name=fingerprints(bits)), "sets")
    shared = shared_fingerprints(info)
    name = fingerprints(bits, shared)
    if shared:
        info = info.withColumn("fp", F.when(F.col("fp").isin(*shared), F.col("fp2")).otherwise(F.col("fp")))
    total, n_texts = info.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    postings = common.written(_postings(docs, n_words, percent, total or 0, text_col, frequent_shingles(info, n_texts), name), "postings")
    wanted = postings.select("fp").distinct()
    # the row of the smallest id, and one without an id where there is no other
    first = info.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "key")).alias("f")).select("fp", F.col("f.id").alias("first"), "f.key")
    wanted = common.written(first.join(wanted, "fp", "left_semi").select(F.col("first").alias("__first"), F.col("key").alias("__key")).distinct(), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    chosen = docs.join(ids, (text_key(text_col) == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__first")), "left_semi")
    sets = common.written(shingle_sets(chosen, n_words, id_col, text_col, with_set=True, name=name).dropDuplicates(["fp"]).select("fp", "hashes"), "hashes")
    classes, checked, links = None, None, None
    for turn in range(LEADER_ROUNDS + 1):
        apart = _labelled(postings, classes)
        pairs = _leader_pairs(apart, turn, percent) if turn < LEADER_ROUNDS else _apart_pairs(apart, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        new = common.written(_verified(pairs, sets, percent), "pairs")
        checked = new.select("a", "b") if checked is None else checked.union(new.select("a", "b"))
        found = new.where("linked").select("a", "b")
        links = found if links is None else links.union(found)
        if turn == 0 or found.limit(1).count():
            classes = common.written(components(links), "classes")
    named = first.join(classes, first.fp == classes.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return info, named.join(least, "component").select(F.col("fp").alias("__fp"), "component", "component_id")


def one_of_each(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of ``docs``, with its columns: that of the smallest id, rows without an id after
    all others, and of several texts of one id that of the smallest digest. Rows without words stand alone and all stay.

    Rows whose id no other row has are told by it; the others, and those without one, by id and text.
    """
    info, named = _components(docs, n_words, percent, "doc_id", "text")
    rows = info.join(named, (info.fp == F.col("__fp")) & (info.n > 0), "left").select("doc_id", "n", "key", "component")
    first = rows.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "key")).alias("f"))
    alone = rows.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.lit(False).alias("__one")).distinct()
    stay = first.select(F.col("f.id").alias("__id"), F.col("f.key").alias("__key"), F.lit(True).alias("__one")).unionByName(alone)
    shared = info.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("doc_id is null or __n > 1").select(F.col("doc_id").alias("__shared"))
    shared = common.written(shared, "shared-ids")
    if not shared.limit(1).count():
        return docs.join(stay.select("__id"), docs.doc_id == F.col("__id"), "left_semi")
    by_id = docs.join(shared, docs.doc_id.eqNullSafe(F.col("__shared")), "left_anti").join(stay.select("__id"), docs.doc_id == F.col("__id"), "left_semi")
    rest = docs.join(shared, docs.doc_id.eqNullSafe(F.col("__shared")), "left_semi")
    rest = rest.withColumn("__key0", text_key("text")).join(stay, F.col("__key0").eqNullSafe(F.col("__key")) & docs.doc_id.eqNullSafe(F.col("__id")))
    once = rest.where("__one").dropDuplicates(["__id", "__key"])
    return by_id.unionByName(once.unionByName(rest.where("not __one")).select(*docs.columns))
