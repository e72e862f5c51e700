"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each worker builds the encoder once. A long text is cut where white space begins: no match of the
splitting pattern spans such a place and none looks back over it, so the parts encode to the ids of
the whole. A long run of white space is a part too: all of it at the end of a text, else all but its
last character, is one match, whose ids are found from its bytes without the pattern, as the
pattern's engine would keep a state for each of its characters. Decoding joins raw bytes, so a token
that ends inside a character loses nothing. The patterns meant are those of public byte-level BPE
vocabularies: white space beside one leading blank never shares a match with other characters.

Defined results: a null text encodes like the empty one (no ids); bytes that are not UTF-8 count as
U+FFFD; texts of any length and any runs are encoded whole, in time about proportional to their
length; an empty table gives an empty result; rows are encoded one by one, so repeated ones give
equal results and there are no ties; columns other than doc_id and text are ignored. The plan is a
scan and one Arrow map: no shuffle, and memory holds one batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters than this are cut at safe boundaries.
LONG = 1 << 16

#: Runs of white space of at least this length are encoded apart; 2 is the least that can be.
LONG_RUN = 1000

# The pattern's white space (Unicode's White_Space, without \x1c to \x1f).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEGINS = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")


@lru_cache(maxsize=4)
def _long_runs(least: int) -> re.Pattern:
    return re.compile(f"[{_WHITE}]{{{least},}}")


def _cut(text: str, start: int, end: int, limit: int) -> Iterator[str]:
    """text[start:end] cut where white space begins, in parts of about ``limit`` characters."""
    while end - start > limit:
        found = _BEGINS.search(text, start + limit, end)
        # Two or more white-space characters belong together, so the next part takes them all.
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < end:
        yield text[start:end]


def safe_parts(text: str, limit: int = LONG, run: int = LONG_RUN) -> Iterator[tuple[str, bool]]:
    """The text in parts that encode independently, and whether a part is one match of white space."""
    start = 0
    for found in _long_runs(max(run, 2)).finditer(text):
        yield from ((part, False) for part in _cut(text, start, found.start(), limit))
        start = found.end() if found.end() == len(text) else found.end() - 1
        yield text[found.start() : start], True
    yield from ((part, False) for part in _cut(text, start, len(text), limit))


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, encoding, limit: int = LONG, run: int = LONG_RUN) -> list[int]:
    """The ids of a whole text."""
    if len(text) <= limit:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    for part, one_match in safe_parts(text, limit, run):
        out += encoding._encode_single_piece(part) if one_match else encoding.encode_ordinary(part)
    return out


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        data = value.as_buffer()
        yield "" if data is None else data.to_pybytes().decode("utf-8", "replace")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, limit: int = LONG) -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            ids = pa.array([encode_text(t, encoding, limit) for t in _texts(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    source = _source(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``data``, the raw bytes of ``ids``; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            data = [encoding.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, limit: int = LONG) -> DataFrame:
    """Encode and decode in one pass: token count and digests of the ids and of the decoded bytes."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            counts, ids_sha, data_sha = [], [], []
            for text in _texts(batch.column("text")):
                ids = encode_text(text, encoding, limit)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                data_sha.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = _source(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_corpus(docs: DataFrame, ranks_path: str, pattern: str, limit: int = LONG) -> DataFrame:
    """doc_id, source, n_tokens, ids, ids_sha256 and decoded_sha256 of every row, in one pass."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [np.asarray(encode_text(t, encoding, limit), "<i4") for t in _texts(part.column("text"))]
                columns = [
                    part.column("doc_id"),
                    part.column("source"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoding.decode_bytes(x.tolist())).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    source = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, source string, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
