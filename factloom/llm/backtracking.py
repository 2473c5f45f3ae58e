"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds the longest token that starts at each byte of a piece. The encoder takes the longest
token that goes with the one before it, a shorter one where it doesn't, and steps back where none does; an end it
stepped back from is never tried again, so a piece takes linear time. Two tokens go together if merging their bytes
alone leaves them apart. A sequence whose neighbours all go together is the one that merging gives, and there is just
one. That rests on a vocabulary in which each token comes of one merge, of tokens merged earlier, and is what its own
bytes merge to; other vocabularies are refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and pairs that a worker keeps, characters of a piece that is kept, and characters split into pieces at once.
CACHED, SHORT, BLOCK = 1 << 18, 32, 1 << 16
#: The settings of a tokenizer file that this encoder knows how to follow.
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the other bytes
    numbered on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids of the pieces met, made where they are missing; long ones aren't kept, and all go when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> list[int]:
        ids = self.make(piece.encode().decode("latin-1"))
        if len(piece) <= SHORT:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


class BacktrackingBpe:
    def __init__(self, settings: dict, pattern: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        model, split = settings["model"], settings["pre_tokenizer"] or {}
        added = settings["added_tokens"]
        other = [k for k, v in _MODEL.items() if model.get(k, v) != v] + [k for k, v in _SPLIT.items() if split.get(k, v) != v]
        other += [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if other or settings["normalizer"] or settings["post_processor"]:
            raise ValueError(f"a tokenizer of another kind: {other}")
        alphabet = byte_alphabet()
        outside = {t["content"]: t["id"] for t in added}
        ids = {bytes(alphabet[c] for c in s): i for s, i in model["vocab"].items() if s not in outside}
        self.outside, table = outside, {i: b for b, i in ids.items()} | {i: s.encode() for s, i in outside.items()}
        size = max(table) + 1
        self.length = [len(table.get(i, b"")) for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self._merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], ids, alphabet, size)
        self.tokens = ahocorasick.Automaton()
        for b, i in ids.items():
            self.tokens.add_word(b.decode("latin-1"), i)
        self.shorter = [-1] * size
        for b, i in ids.items():
            self.shorter[i] = next((ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ids), -1)
        self.tokens.make_automaton()
        self.pattern, self.cut, self.seam = regex.compile(pattern), regex.compile("|".join(map(regex.escape, sorted(outside, key=len, reverse=True)))), regex.compile(r"(?<=\S)\s")
        # characters newer than Python's tables are split by the library, which may know more or fewer of them
        self.library = Tokenizer.from_str(json.dumps(settings | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})).pre_tokenizer
        self.assigned: set[str] = set()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = _Kept(self.piece)

    def _merges(self, merges: list, ids: dict[bytes, int], alphabet: dict[str, int], size: int) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        of = lambda s: ids[bytes(alphabet[c] for c in s)]
        for r, (a, b) in enumerate(merges):
            x, y, whole = of(a), of(b), of(a + b)
            if self.born[whole] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            if any(self.length[p] > 1 and self.born[p] < 0 for p in (x, y)):
                raise ValueError(f"{a + b!r} is merged before its parts")
            self.rank[x, y], self.born[whole], self.left[whole], self.right[whole] = r, r, x, y
        for b, i in ids.items():
            if len(b) > 1 and (self.born[i] < 0 or not self._apart(self.left[i], self.right[i], self.born[i])):
                raise ValueError(f"the bytes of token {i} don't merge to it")

    def _apart(self, x: int, y: int, until: int = 1 << 60) -> bool:
        """Whether no merge of rank below ``until`` joins the bytes of two neighbouring tokens across their seam.

        The symbols at the seam are those down x's right side and y's left side, each from when it is merged until it
        is merged on. From the last back, every two that are there together are looked up; of equal merges the left
        one comes first."""
        rank, born = self.rank, self.born
        x_ends, y_ends = until, until - 1
        while True:
            r = rank.get((x, y))
            if r is not None and r < x_ends and r <= y_ends:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                x_ends, x = born[x], self.right[x]
            else:
                y_ends, y = born[y], self.left[y]

    def _go_together(self, x: int, y: int) -> bool:
        found = self.pairs.get((x, y))
        if found is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            found = self.pairs[x, y] = self._apart(x, y)
        return found

    def piece(self, data: str) -> list[int]:
        """Ids of one piece, given as its bytes in Latin-1."""
        n, length, shorter = len(data), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.tokens.iter(data):
            longest[end - length[token] + 1] = token
        ends, ids, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while True:
            if token < 0:
                if not ids:
                    raise ValueError(f"no tokens make {data[:80]!r}")
                ends[at] = 0
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
            elif ends[at + length[token]] and (not ids or self._go_together(ids[-1], token)):
                ids.append(token)
                at += length[token]
                if at == n:
                    return ids
                token = longest[at]
            else:
                token = shorter[token]

    def _newer(self, text: str) -> bool:
        """Whether a character is there that Python's Unicode tables don't have."""
        if text.isascii():
            return False
        for c in set(text) - self.assigned:
            if unicodedata.category(c) == "Cn":
                return True
            self.assigned.add(c)
        return False

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of the pieces of a text without added tokens. It is split in blocks, each of which begins with the first
        blank after a character that is none: there is always a seam there."""
        if self._newer(text):
            yield from (self.known[text[a:b]] for _, (a, b) in self.library.pre_tokenize_str(text))
            return
        at = 0
        while at < len(text):
            seam = self.seam.search(text, at + BLOCK)
            end = seam.start() if seam else len(text)
            yield from map(self.known.__getitem__, self.pattern.findall(text, at, end))
            at = end

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``; an added token's string is that token."""
        ids, at = [], 0
        for m in self.cut.finditer(text) if self.outside else ():
            ids += [*chain.from_iterable(self._plain(text[at : m.start()])), self.outside[m.group()]]
            at = m.end()
        ids += chain.from_iterable(self._plain(text[at:] if at else text))
        return np.array(ids, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, by their places in the table of all tokens' bytes."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        return self.bytes[places].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def public_bpe(name: str = "byte_bpe_50k.json") -> BacktrackingBpe:
    """The tokenizer of a public file, once for each Python worker."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return BacktrackingBpe(json.load(f), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded text in
    UTF-8), and with ``keep_ids`` the ids. A null text counts as empty (no tokens, digests of nothing), null and
    repeated ids and repeated rows are encoded like others, an empty table gives no rows, and other columns, whatever
    their names, are not looked at. Nothing is shuffled; a worker holds one batch and the pieces it keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = public_bpe(tokenizer)
        for batch in batches:
            n, digests, decoded, kept = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                out.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<long>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
