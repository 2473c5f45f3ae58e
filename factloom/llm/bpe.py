"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Every text is halved until a half fits a leaf of some hundred characters; neighbours are joined by scanning anew from the last match boundary of the
left half that its end can't have influenced, piece by piece, until a boundary coincides with one of the right half:
the pattern looks only forward, so everything beyond is then the same. A single piece too long for a leaf is halved
as bytes: the window around a seam is re-encoded and doubled until both of its outer token pairs are pairs that the
encoder itself keeps, which is what makes a token sequence the encoding of its bytes. Decoding halves the ids and
concatenates up the tree.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters the pattern can look at beyond the end of a match (a contraction's two letters, and one more).
LOOKAHEAD = 3
#: Characters of a leaf, bytes of a leaf of one piece, ids of a leaf of decoding, and pieces whose ids a worker keeps.
LEAF, PIECE_LEAF, IDS_LEAF, CACHED = 512, 1 << 10, 1 << 10, 1 << 18


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF, ids_leaf: int = IDS_LEAF):
        import regex
        import tiktoken

        self.table = {i: b for b, i in ranks.items()}
        self.whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.whole._encode_single_piece
        self.pattern, self.leaf, self.piece_leaf, self.ids_leaf = regex.compile(pattern), leaf, piece_leaf, ids_leaf
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``."""
        return np.fromiter((i for piece in self._tree(text, 0, len(text))[1] for i in piece), "<u4") if text else np.zeros(0, "<u4")

    def _ids(self, piece: str) -> list[int]:
        """Ids of a match; those of short ones are kept, as words occur again."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.piece(piece.encode())
            if len(piece) <= 32:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def _tree(self, text: str, a: int, b: int) -> tuple[list[int], list[list[int]]]:
        """Starts and ids of the matches of ``text[a:b]``, taken as a whole text."""
        if b - a <= self.leaf:
            pieces = self.pattern.findall(text, a, b)
            starts = list(accumulate(map(len, pieces), initial=a))
            if starts.pop() != b:  # the pattern leaves gaps
                starts = [m.start() for m in self.pattern.finditer(text, a, b)]
            return starts, list(map(self._ids, pieces))
        middle = (a + b) // 2
        return self._join(text, self._tree(text, a, middle), self._tree(text, middle, b), a, middle, b)

    def _join(self, text, left, right, a: int, middle: int, b: int):
        keep = max(0, bisect.bisect_right(left[0], middle - LOOKAHEAD) - 1)
        at = left[0][keep] if keep < len(left[0]) else a
        starts, ids = left[0][:keep], left[1][:keep]
        for m in self.pattern.finditer(text, at, b):
            s, e = m.span()
            if s >= middle and (k := bisect.bisect_left(right[0], s)) < len(right[0]) and right[0][k] == s:
                return starts + right[0][k:], ids + right[1][k:]
            starts.append(s)
            ids.append(self._ids(text[s:e]))
        return starts, ids

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match."""
        if len(data) <= self.piece_leaf:
            return self.single(data)
        half = len(data) // 2
        return self._merge(self.piece(data[:half]), self.piece(data[half:]))

    def _kept(self, x: int, y: int) -> bool:
        return self.single(self.table[x] + self.table[y]) == [x, y]

    def _merge(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.single(b"".join(self.table[i] for i in left[a:] + right[:b]))
            if (a == 0 or self._kept(left[a - 1], window[0])) and (b == len(right) or self._kept(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``: halves decoded and concatenated, up from leaves."""
        if len(ids) <= self.ids_leaf:
            return b"".join(map(self.table.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def public_bpe(name: str = "byte_bpe_50k.tiktoken") -> TreeBpe:
    """The tokenizer of a public rank file, once for each Python worker."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeBpe(ranks, public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256, and with
    ``keep_ids`` the ids as binary. A null text counts as empty (no tokens, digests of nothing); repeated rows give
    repeated results; other columns are not looked at. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = public_bpe(tokenizer)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                raw = ids.tobytes()
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), raw if keep_ids else None))
            n, a, b, raw = zip(*rows) if rows else ((), (), (), ())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out, names = [*out, pa.array(raw, pa.binary())], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
