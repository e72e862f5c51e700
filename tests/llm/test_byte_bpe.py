"""Byte-level BPE against the library on whole texts."""

import hashlib
import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import byte_bpe
from tests.llm import cases

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_round_trip(spark):
    rows = byte_bpe.round_trip(cases.table(spark), PATH, PATTERN, limit=100).collect()
    encoding = byte_bpe.encoder(PATH, PATTERN)
    want = []
    for doc_id, text, *_ in cases.ROWS:
        ids = encoding.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    encoded = byte_bpe.encode(cases.table(spark), PATH, PATTERN)
    data = [bytes(r.data) for r in byte_bpe.decode(encoded, PATH, PATTERN).collect()]
    assert sorted(data) == sorted((r[1] or "").encode() for r in cases.ROWS)


def test_empty_table(spark):
    assert byte_bpe.round_trip(cases.empty(spark), PATH, PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé漢1 \n\t \xa0\u2003\x1c\x85.!"), max_size=120), st.integers(1, 10), st.integers(2, 5))
def test_parts_encode_alone(text, limit, run):
    encoding = byte_bpe.encoder(PATH, PATTERN)
    assert byte_bpe.encode_text(text, encoding, limit, run) == encoding.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "    ", "\n\n\n", "don't", " 12", "\x1c", "\xa0\xa0\xa0", "!?"]), max_size=60), st.integers(1, 6))
def test_runs_of_white_space_encode_alone(parts, limit):
    encoding, text = byte_bpe.encoder(PATH, PATTERN), "".join(parts)
    assert byte_bpe.encode_text(text, encoding, limit, 2) == encoding.encode_ordinary(text)


def test_very_long_runs(spark):
    """Texts on which the library fails as a whole, or which have no white space at all."""
    encoding, million = byte_bpe.encoder(PATH, PATTERN), 1_000_000
    texts = ["a" + " " * million + "b", " " * million, "\n" * million + "x", "x" * million, "ab" + "\t \n" * 400_000 + "cd" + " " * million, "漢" * 300_000]
    got = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), PATH, PATTERN)
    decoded = {r.doc_id: bytes(r.data) for r in byte_bpe.decode(got, PATH, PATTERN).collect()}
    assert all(decoded[i] == t.encode() for i, t in enumerate(texts))
    # The same ids as from the library, which takes shorter runs of the same kind.
    head = byte_bpe.encode_text(texts[0], encoding)
    assert head[0] == encoding.encode_ordinary("a")[0] and head[-1:] == encoding.encode_ordinary(" b")
    assert head[1:-1] == encoding.encode_ordinary(" ") * (million - 1)
