import hashlib
import json
import random

import pytest

from factloom.llm import backtracking


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    return backtracking.public_bpe(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rnd = random.Random(2)
    kinds = ["ab", "abc \n", "aAbB 's't're1,.é中٣", "".join(map(chr, range(32, 127))), "ethioansr"]
    made = ["".join(rnd.choice(k) for _ in range(rnd.randint(0, 80))) for k in kinds for _ in range(300)]
    made += ["", "<|endoftext|>", "a <|endoftext|>  <|endoftext|> b<|endo", "a" * 50_000, "the " * 20_000 + "end", " " * 70_000 + "x", "ab" * 3000, "՘a ՘ 1꟒", "x" + "\U0001f600" * 500]
    return [*made, "\x00\x1c\x85\xa0 　 ​ a\r\n\r\n b"]


def test_ids_and_texts_of_the_library(both):
    own, library = both
    for t in texts():
        ids, want = own.encode(t), library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == t


def test_every_character_is_split_as_in_the_library(both):
    own, library = both
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(known), 997):
        t = "".join(f"a{c}1{c}.{c} {c} " for c in known[at : at + 997] if not own._newer(c))
        assert own.pattern.findall(t) == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]


def test_pieces_end_as_merging_does(both):
    # a small vocabulary whose longest tokens often can't be taken, against merging pair by pair
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("bc", "a"), ("abc", "abc"), ("a", "a"), ("aa", "aa"), ("c", "ab")]
    letters = list(backtracking.byte_alphabet())
    vocab = {t: i for i, t in enumerate([*letters, *(x + y for x, y in merges)])}
    settings = {"added_tokens": [], "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
                "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}, "version": "1.0", "truncation": None, "padding": None, "decoder": None}
    bad = json.loads(json.dumps(settings))
    bad["model"]["merges"].append(["a", "bc"])  # abc by two merges
    with pytest.raises(ValueError):
        backtracking.BacktrackingBpe(bad, r"\S+|\s+")
    own, rnd = backtracking.BacktrackingBpe(settings, r"\S+|\s+"), random.Random(3)
    for _ in range(3000):
        s = [rnd.choice("abc") for _ in range(rnd.randint(1, 14))]
        want = list(s)
        while len(want) > 1:
            r, i = min((merges.index(p) if p in merges else 99, i) for i, p in enumerate(zip(want, want[1:])))
            if r == 99:
                break
            want[i : i + 2] = ["".join(want[i : i + 2])]
        assert own.encode("".join(s)).tolist() == [vocab[t] for t in want]


def test_rows(spark, both):
    rows = [(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "a b", 8), (2, "a b", 8), (3, "x " * 300_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.token_ids) for r in backtracking.encode_documents(docs, keep_ids=True).collect())
    want = []
    for i, t, _ in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want)
    assert backtracking.encode_documents(docs.limit(0)).count() == 0
