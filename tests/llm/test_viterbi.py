import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from ledgerlens.llm import viterbi

from .helpers import documents, empty_documents, odd_documents


@pytest.fixture(scope="module")
def counters():
    pieces, fallback = viterbi.vocabulary()
    model = Tokenizer(Unigram(pieces, 0, fallback)).model
    return viterbi.UnigramCounter(pieces, fallback), lambda t: len(model.tokenize(viterbi.MARK + t.replace(" ", viterbi.MARK))) if t else 0


@given(st.text(alphabet="athe nd.\n▁é日🙂0 <>x", max_size=60))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_library(counters, text):
    assert counters[0].count(text) == counters[1](text)


def test_ties_take_the_library_s_choice():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0), ("b", -4.0), ("ab", -5.0)]
    model = Tokenizer(Unigram(pieces, 0, False)).model
    mine = viterbi.UnigramCounter(pieces, False)
    for t in ("a", "aa", "aaa", "aaaa", "aab", "abab", "a aa b", "baab", "xyz", "axyzb", "a xy zz", "xy  x", " ", "é🙂a日x"):
        assert mine.count(t) == len(model.tokenize("▁" + t.replace(" ", "▁"))), t


@given(st.text(alphabet="ab xyé▁", max_size=40))
@settings(max_examples=200, deadline=None)
def test_unknowns_without_byte_fallback_are_fused(text):
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("▁a", -2.5), ("ab", -1.5)]
    model = Tokenizer(Unigram(pieces, 0, False)).model
    want = len(model.tokenize("▁" + text.replace(" ", "▁"))) if text else 0
    assert viterbi.UnigramCounter(pieces, False).count(text) == want


def test_documents(spark, counters):
    docs = documents(spark)
    want = {r.doc_id: counters[1](r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in viterbi.token_counts(docs).collect()} == want


def test_odd_documents(spark, counters):
    docs = odd_documents(spark)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in viterbi.token_counts(docs).collect())
    assert got == sorted((r.doc_id or 0, counters[1](r.text or "")) for r in docs.collect())
    assert viterbi.token_counts(empty_documents(spark)).count() == 0
