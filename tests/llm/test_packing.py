"""Packing: ids against the tokenizer, and an exact round trip of every piece."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from streamloom.llm import packing
from streamloom.llm.queries import tokenizer

TEXTS = ["a  b", "  x", "x \n y", "\n\n\n", "I'll  'll don't", "\x1cab !\x1c c", "é  z", "<|endoftext|> a<|endoftext|>b", "漢字 仮名　x 123 45", "w " * 9000, "", None, "tab\tand\x0bvt nbsp em", "x" * 5000]


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 1]


def test_chunks_give_the_tokenizers_ids(reference):
    fast, plain = packing.chunk_ids(*tokenizer()), packing.chunk_ids(tokenizer()[0])
    for text in TEXTS:
        want = np.array(reference(text)[:-1], "<u4").tobytes()
        assert fast.encode(text or "") == want == plain.encode(text or "")


def test_special_tokens():
    for end in (3, 1):
        assert np.frombuffer(packing.chunk_ids(*tokenizer()[:end]).encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
        paths = (*tokenizer()[:end], None, None)[:3]
        plain = np.frombuffer(packing.chunk_ids(*paths, True).encode("a<|endoftext|>b"), "<u4").tolist()
        assert 50256 not in plain and plain[0] == 64 and plain[-1] == 65


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60).flatmap(lambda t: st.sampled_from([t, f"{t}<|endoftext|>{t}", f"<|endoftext|> {t} <|endoftext|>"])))
def test_any_text(reference, text):
    assert packing.chunk_ids(*tokenizer()).encode(text) == np.array(reference(text)[:-1], "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_is_first_fit(lengths):
    bins, offsets = packing.first_fit(lengths, 50)
    room = []
    for need, b, o in zip(lengths, bins, offsets, strict=True):
        want = next((k for k, r in enumerate(room) if r >= need), len(room))
        if want == len(room):
            room.append(50)
        assert (b, o) == (want, 50 - room[want])
        room[want] -= need


def test_every_id_lies_in_one_piece(spark, reference):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS * 3)] + [(None, "null id", 0), (5, TEXTS[5], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = packing.pack_documents(df, tokenizer(), group_docs=16).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, text in {r[0]: r[1] for r in rows}.items():
        ids = reference(text)
        pieces = sorted({(r.start, r.length, r.ids_crc32) for r in by_doc[i]})
        assert all(r.doc_tokens == len(ids) for r in by_doc[i])
        assert [s for s, _, _ in pieces] == list(np.cumsum([0, *[n for _, n, _ in pieces]])[:-1]) and sum(n for _, n, _ in pieces) == len(ids)
        for s, n, crc in pieces:
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == crc
    assert len(by_doc[5]) == 2
    assert packing.pack_documents(df.limit(0), tokenizer()).count() == 0
