import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import packing

from .helpers import documents, empty_documents, odd_documents


@given(st.lists(st.integers(1, 32), max_size=200))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece_once_and_fits(lengths):
    counts = np.bincount(lengths, minlength=33)
    used = Counter()
    plan = packing.plan(counts, 32)
    for pattern, times in plan:
        assert sum(pattern) <= 32 and times > 0
        for s in pattern:
            used[s] += times
    assert used == Counter(lengths)
    # no two sequences that are both at most half full
    assert sum(times for p, times in plan if 2 * sum(p) <= 32) <= 1


def test_exact_complements_are_found():
    counts = np.zeros(101, np.int64)
    for s in (70, 30, 60, 25, 15, 52, 20, 17, 11):
        counts[s] += 5
    assert all(sum(p) == 100 for p, _ in packing.plan(counts, 100))


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_pack_against_the_tokenizer(spark, make):
    docs = make(spark)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    rows = packing.pack(docs).collect()
    space, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length <= 1024
        space[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.piece, tuple(ids.tolist())))
    for s in space.values():  # gapless from 0
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert total == sum(len(ids) * n for (_, ids), n in want.items())
    assert len(space) <= max(1.02 * total / 1024 + 1, 1)
    single = {d for (d, _), n in want.items() if sum(m for (e, _), m in want.items() if e == d) == 1}
    for d in single:
        parts = sorted(pieces[d])
        assert [p for _, p, _ in parts] == list(range(len(parts)))
        assert sum((ids for _, _, ids in parts), ()) in {i for e, i in want if e == d}
        assert all(len(ids) == 1024 for _, _, ids in parts[1:])
    digest = packing.pack(docs, digest=True).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in digest) == Counter(
        (r.doc_id, r.piece, zlib.crc32(bytes(r.ids))) for r in rows)


def test_empty(spark):
    assert packing.pack(empty_documents(spark)).count() == 0


def test_added_tokens_in_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, theirs = packing.ByteTokenizer(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y <|endoftext|", "<|endoftext|> \n<|endoftext|>z"):
        got = np.frombuffer(mine.ids(text), "<u4").tolist()
        assert got == theirs.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(mine.ids("a <|endoftext|> b"), "<u4")


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, theirs = packing.ByteTokenizer(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    assert mine.ranked
    return mine, lambda text: np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_code_point_against_the_tokenizer(both):
    mine, theirs = both
    for lo in range(0, 0x110000, 64):
        points = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        text = "|".join(f"a{c}1 {c}b {c}{c}? {c}" for c in points)
        assert mine.ids(text) == theirs(text), hex(lo)


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t ", "a", "the", "'s", "1", "é", "　", " ", "😀", "!", "\x1c", "\x85",
                                 "<|endoftext|>", "<|endof"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_short_stretches_against_the_tokenizer(both, parts):
    """Cuts and the way piece by piece give the ids of the whole text."""
    mine, theirs = both
    text, stretch = "".join(parts), mine.stretch
    try:
        for mine.stretch in (1, 5, stretch):
            assert mine.ids(text) == theirs(text)
    finally:
        mine.stretch = stretch


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "ab" * 300_000, "\n " * 200_000 + "end", "one two  three\n" * 40_000, "😀" * 150_000])
def test_very_long_texts_against_the_tokenizer(both, text):
    mine, theirs = both
    assert mine.ids(text) == theirs(text)


def test_vocabulary_out_of_merge_order(tmp_path, both):
    """Such a file goes through its own model."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    last = spec["model"]["merges"].pop()
    del spec["model"]["vocab"][last.replace(" ", "") if isinstance(last, str) else "".join(last)]
    a, b = list(spec["model"]["vocab"])[-2:]
    vocab = spec["model"]["vocab"]
    vocab[a], vocab[b] = vocab[b], vocab[a]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    mine, theirs = packing.ByteTokenizer(str(path), public_tokenizers.PATTERN), Tokenizer.from_file(str(path))
    assert mine.ranked is None
    text = "Words of a text, with the rarest: " + a.replace("Ġ", " ") + b.replace("Ġ", " ")
    assert np.frombuffer(mine.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
