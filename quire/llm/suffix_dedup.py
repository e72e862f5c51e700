"""Removal of repeated passages: distributed merge sort of suffixes, aware of common prefixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
doc_id. Not every suffix has to be sorted. In each string of that length the least-hashed ``CORE``
bytes (leftmost on ties) are its anchor; equal strings have equal anchors at equal offsets. So it is
enough to sort the suffixes that start at anchors, each with the ``REACH`` bytes before it.

1. Runs: map tasks pack documents into runs of about ``run_bytes``, stored compressed.
2. Filter: each run sends the sorted hashes of its anchors' cores, delta-coded, to owners of hash
   ranges; an owner answers with a bit per hash: whether another run or document has it too.
3. Exchange: of the anchors left, a run sorts the distinct suffixes with their smallest doc_id, and
   sends them front-coded (length shared with the suffix before, then the rest) to the owners of
   ranges of core hashes.
4. Merge: an owner merges its runs with a loser tree whose nodes know the prefix length that a loser
   shares with the last winner, so no byte of a known prefix is compared again. The lengths shared
   by neighbours of the merged order give the classes of equal strings at every offset.
5. Answers go back to the runs: for each suffix and offset the smallest doc_id that has the string.
   A run finds its anchors and the order of its suffixes anew, which is cheaper than sending them.

Within a run equal suffixes travel once, so a passage that a third of all documents share costs an
owner one entry a run. A step's memory is a run (a text longer than ``run_bytes`` is a run of its
own) or a range, of which hot passages make up one entry a run; nothing is dropped. Runs send one
piece to each range that they have anchors of, so beyond some ten thousand ranges ``run_bytes`` and
``range_bytes`` have to grow with the corpus.

Defined results: null counts as empty; texts shorter than ``LENGTH`` bytes lose nothing; very long
texts are searched whole; a null doc_id counts as larger than any; rows with the same doc_id, repeated
ones too, tie and do not remove each other's bytes; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import runs, text_or_empty, written

LENGTH, CORE = 50, 32
#: Offsets of an anchor in a string: 0 to REACH.
REACH = LENGTH - CORE
RUN_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
LEAST_RANGES = 64
#: Bytes of texts that a task of a merge is meant to have the ranges of.
TASK_BYTES = 32 << 20
#: Bytes of answers that may be broadcast; with more, runs are shuffled to them.
FEW_MARKS = 32 << 20

_SEGMENT = 20
_NO_ID = 2**63 - 1
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def rolling(codes: np.ndarray) -> np.ndarray:
    """A hash of the CORE codes from each position, by doubling."""
    value, width, power = codes.astype(np.uint64), 1, int(_SALT)
    while width < CORE:
        value = value[:-width] * np.uint64(power) + value[width:]
        width, power = 2 * width, power * power % 2**64
    return _mixed(value, 0xFF51AFD7ED558CCD)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    at = 1
    while 2 * at <= width:
        values, at = np.minimum(values[:-at], values[at:]), 2 * at
    return np.minimum(values[: len(values) - (width - at)], values[width - at :]) if width > at else values


class Run:
    """Documents laid out in one buffer: codes are byte + 1, with LENGTH zeros after each text."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]) -> None:
        self.ids, self.sizes = ids, np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + LENGTH)])[:-1] + LENGTH
        self.codes = np.zeros(LENGTH + int((self.sizes + LENGTH).sum()), np.uint8)
        for start, text in zip(self.starts, texts, strict=True):
            self.codes[start : start + len(text)] = np.frombuffer(text, np.uint8)
            self.codes[start : start + len(text)] += 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, core hash, least and largest offset of the strings that each anchor stands for."""
        valid = np.zeros(len(self.codes) + 1, np.int8)
        has = self.sizes >= LENGTH
        valid[self.starts[has]] += 1
        valid[self.starts[has] + self.sizes[has] - LENGTH + 1] -= 1
        valid = valid[:-1].cumsum(dtype=np.int8).astype(bool)
        found = []
        step = (1 << _SEGMENT) - 2 * LENGTH
        for s in range(0, len(self.codes), step):
            codes = self.codes[s : s + (1 << _SEGMENT)]
            if len(codes) < LENGTH:
                break
            core = rolling(codes)
            low = np.uint64(_SEGMENT)
            least = _sliding_least((core >> low << low) | np.arange(len(core), dtype=np.uint64), REACH + 1)[:step]
            at = np.flatnonzero(valid[s : s + len(least)])
            anchor = (least[at] & np.uint64((1 << _SEGMENT) - 1)).astype(np.int64)
            if not len(at):
                continue
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
            last = np.append(first[1:], len(at)) - 1
            a = anchor[first]
            found.append((a + s, core[a], a - at[last], a - at[first]))
        if not found:
            empty = np.empty(0, np.int64)
            return empty, np.empty(0, np.uint64), empty, empty
        position, core, near, far = (np.concatenate(x) for x in zip(*found, strict=True))
        return position, _mixed(core, 0xC4CEB9FE1A85EC53), near, far

    def owners(self, positions: np.ndarray) -> np.ndarray:
        """doc_id (null as the largest) of each position."""
        return self.ids[np.searchsorted(self.starts, positions, side="right") - 1]


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _swell(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob; integers as byte planes of their differences."""
    head, parts = [], []
    for a in arrays:
        plain = a.dtype == np.uint8
        body = a if plain else np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, a.dtype.itemsize).T
        head.append(f"{a.dtype.str}:{','.join(map(str, a.shape))}")
        parts.append(np.ascontiguousarray(body).tobytes())
    front = ";".join(head).encode()
    return _squeeze(len(front).to_bytes(4, "little") + front + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data = _swell(data)
    end = 4 + int.from_bytes(data[:4], "little")
    out = []
    for part in data[4:end].decode().split(";"):
        kind, _, shape = part.partition(":")
        kind, shape = np.dtype(kind), tuple(map(int, shape.split(",")))
        size = int(np.prod(shape)) * kind.itemsize
        raw = np.frombuffer(data, np.uint8, size, end)
        end += size
        out.append(raw.reshape(shape) if kind == np.uint8 else np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel().cumsum(dtype=kind))
    return out


_RUNS = "run long, docs binary"
_PIECES = "kind int, part int, run long, data binary"


def _piece_batches(rows: Iterator[tuple], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > most:
            yield _piece_batch(held)
            held, size = [], 0
    if held:
        yield _piece_batch(held)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["kind", "part", "run", "data"])


def pack_runs(docs: DataFrame, run_bytes: int) -> DataFrame:
    """Documents packed into compressed runs; a run is named by its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, texts, size = None, [], [], 0

        def out() -> pa.RecordBatch:
            body = np.array([_NO_ID if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array([len(t) for t in texts], np.int64)
            blob = pack(*body, np.frombuffer(b"".join(texts), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], ["run", "docs"])

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                name = row.as_py() if name is None else name
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= run_bytes:
                    yield out()
                    name, ids, texts, size = None, [], [], 0
        if ids:
            yield out()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return written(source.mapInArrow(run, _RUNS), "suffix-runs")


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, null, sizes, body = unpack(blob)
    ends = np.cumsum(sizes)
    data = body.tobytes()
    return ids, null.astype(bool), [data[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def _run_of(blob: bytes) -> Run:
    ids, _, texts = _load(blob)
    return Run(ids, texts)


def _distinct_cores(run: Run, bits: int) -> tuple:
    """Anchors, and the sorted distinct keys (``bits`` + 32 bits) of their cores with the inverse."""
    position, core, near, far = run.anchors()
    key = core >> np.uint64(32 - bits)
    distinct, inverse = np.unique(key, return_inverse=True)
    return position, near, far, key, distinct, inverse


def _cuts(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of sorted keys begins, and the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(32)
    return np.append(np.searchsorted(sorted_keys, edges), len(sorted_keys))


def _dealt(pieces: DataFrame, bits: int, parts: int) -> DataFrame:
    """Pieces in order of range and run, a range or some next to each other to a task."""
    part = F.shiftright(F.col("part").cast("long") * parts, bits).cast("int")
    return pieces.repartitionById(parts, part).sortWithinPartitions("part", "run")


def core_pieces(stored: DataFrame, bits: int) -> DataFrame:
    """Per run and range: the distinct core keys, and whether several documents of the run have them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, blob in zip(batch.column("run").to_pylist(), batch.column("docs"), strict=True):
                run = _run_of(blob.as_py())
                position, _, _, _, distinct, inverse = _distinct_cores(run, bits)
                owner = run.owners(position)
                low, high = np.full(len(distinct), _NO_ID), np.full(len(distinct), -_NO_ID)
                np.minimum.at(low, inverse, owner)
                np.maximum.at(high, inverse, owner)
                cuts = _cuts(distinct, bits)
                rest = distinct.astype(np.uint32)
                for part in np.flatnonzero(np.diff(cuts)):
                    s, e = cuts[part], cuts[part + 1]
                    yield 0, int(part), name, pack(rest[s:e], np.packbits(low[s:e] != high[s:e]))

    return stored.mapInArrow(lambda batches: _piece_batches(rows(batches)), _PIECES)


def shared_cores(pieces: DataFrame, bits: int, parts: int) -> DataFrame:
    """Answers: per run and range one bit for each key, whether it is in several documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table in runs(batches, ["part"], together=False):
            part = table.column("part")[0].as_py()
            names, keys, several = table.column("run").to_pylist(), [], []
            for data in table.column("data"):
                rest, bits = unpack(data.as_py())
                keys.append(rest)
                several.append(np.unpackbits(bits, count=len(rest)).astype(bool))
            order, count = np.unique(np.concatenate(keys), return_counts=True)
            count[np.searchsorted(order, np.concatenate([k[m] for k, m in zip(keys, several, strict=True)]))] += 1
            for name, key in zip(names, keys, strict=True):
                yield 1, part, name, np.packbits(count[np.searchsorted(order, key)] > 1).tobytes()

    return _dealt(pieces, bits, parts).mapInArrow(lambda batches: _piece_batches(rows(batches)), _PIECES)


def _fill_contexts(codes: np.ndarray, position: np.ndarray, out: np.ndarray, step: int = 1 << 15) -> None:
    """Rows of LENGTH codes from each position on, then the REACH codes before it, nearest first."""
    offsets = np.concatenate([np.arange(LENGTH), -1 - np.arange(REACH)])
    for i in range(0, len(position), step):
        out[i : i + step] = codes[position[i : i + step, None] + offsets]


def _shared_with_last(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_coded(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows as shared lengths and the codes that follow."""
    shared = _shared_with_last(suffixes)
    return shared, suffixes[np.arange(suffixes.shape[1]) >= shared[:, None]]


def front_decoded(shared: np.ndarray, rest: np.ndarray, width: int = LENGTH) -> np.ndarray:
    kept = np.arange(width) >= shared[:, None]
    out = np.zeros(kept.shape, np.uint8)
    out[kept] = rest
    index = np.arange(len(shared))
    for c in range(width):
        out[:, c] = out[np.maximum.accumulate(np.where(kept[:, c], index, 0)), c]
    return out


def with_marks(stored: DataFrame, answers: DataFrame, few_marks: int = FEW_MARKS) -> DataFrame:
    """Runs with their answers. These are a hundredth of the texts; up to ``few_marks`` bytes in all,
    which is checked, they are broadcast, beyond it the runs are shuffled to them."""
    marks = answers.groupBy("run").agg(F.collect_list(F.struct("part", "data")).alias("marks"))
    total = answers.agg(F.sum(F.octet_length("data") + 16)).first()[0] or 0
    return stored.join(F.broadcast(marks) if total <= few_marks else marks, "run", "left")


@dataclass
class Members:
    """The anchors of a run that are left, in order of position, and which distinct suffix each has;
    of each suffix, in sorted order, the range, the context and the smallest doc_id."""

    position: np.ndarray
    near: np.ndarray
    far: np.ndarray
    number: np.ndarray
    part: np.ndarray
    context: np.ndarray
    least: np.ndarray


def members(run: Run, marks: list | None, bits: int) -> Members | None:
    """What the answers about its cores leave of a run; None if that is nothing."""
    if not marks:
        return None
    position, near, far, key, distinct, inverse = _distinct_cores(run, bits)
    cuts = _cuts(distinct, bits)
    several = np.zeros(len(distinct), bool)
    for m in marks:
        s, e = cuts[m["part"]], cuts[m["part"] + 1]
        several[s:e] = np.unpackbits(np.frombuffer(m["data"], np.uint8), count=e - s)
    stay = several[inverse]
    if not stay.any():
        return None
    position, near, far, part = position[stay], near[stay].astype(np.uint8), far[stay].astype(np.uint8), (key[stay] >> np.uint64(32)).astype(np.uint32)
    del key, distinct, inverse, several, stay
    # A row has the range, the context and the two offsets; rows sort as byte strings.
    rows = np.empty((len(position), 4 + LENGTH + REACH + 2), np.uint8)
    rows[:, :4] = part.astype(">u4").view(np.uint8).reshape(-1, 4)
    _fill_contexts(run.codes, position, rows[:, 4:-2])
    rows[:, -2], rows[:, -1] = near, far
    packed = rows.view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(packed, kind="stable").astype(np.int32)
    rows, packed = None, packed[order]
    changed = np.append(True, packed[1:] != packed[:-1])
    number = np.empty(len(order), np.int32)
    number[order] = changed.cumsum(dtype=np.int32) - 1
    least = np.full(int(changed.sum()), _NO_ID)
    np.minimum.at(least, number, run.owners(position))
    context = packed[changed].view(np.uint8).reshape(len(least), -1)[:, 4:]
    return Members(position, near, far, number, part[order[changed]], context, least)


def suffix_pieces(marked: DataFrame, bits: int) -> DataFrame:
    """Front-coded sorted suffixes per run and range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, docs, marks in zip(batch.column("run").to_pylist(), batch.column("docs"), batch.column("marks"), strict=True):
                found = members(_run_of(docs.as_py()), marks.as_py(), bits)
                if found is None:
                    continue
                edges = np.searchsorted(found.part, np.arange((1 << bits) + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    s, e = edges[p], edges[p + 1]
                    shared, rest = front_coded(found.context[s:e, :LENGTH])
                    yield 2, int(p), name, pack(np.array([s]), shared, rest, np.ascontiguousarray(found.context[s:e, LENGTH:].T), found.least[s:e])

    return marked.mapInArrow(lambda batches: _piece_batches(rows(batches)), _PIECES)


def _first_difference(x: bytes, y: bytes, known: int) -> int:
    """Where two texts of one length differ, their length if nowhere; the known prefix is not read."""
    if x[known:] == y[known:]:
        return len(x)
    while x[known] == y[known]:
        known += 1
    return known


def loser_tree(texts: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs: the run of each output and the prefix that it shares with the output before.

    A loser remembers the length it shares with the last winner, and a run's next text the length it
    shares with the one before, which has just won: so lengths decide most matches, and bytes are
    compared only after the longer known prefix."""
    k = len(texts)
    now, at = [t[0] for t in texts], [0] * k
    ends = [len(t) for t in texts]
    loser, known = [-1] * k, [0] * k

    def first_match(a: int, b: int) -> tuple[int, int, int]:
        x, y = now[a], now[b]
        d = _first_difference(x, y, 0)
        return (a, b, d) if x[d:] <= y[d:] else (b, a, d)

    # Nodes 1 to k - 1 are matches, k to 2k - 1 the runs; all start with nothing known.
    winner = [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winner[node], loser[node], known[node] = first_match(winner[2 * node], winner[2 * node + 1])
    w, h = winner[1], 0
    out, lengths = [], []
    for _ in range(sum(ends)):
        out.append(w)
        lengths.append(h)
        i = at[w] = at[w] + 1
        if i < ends[w]:
            now[w], h = texts[w][i], shared[w][i]
        else:
            h = -1
        node = (w + k) >> 1
        while node:
            other = known[node]
            if other > h:
                rival = loser[node]
                loser[node], known[node], w, h = w, h, rival, other
            elif other == h and h >= 0:
                rival = loser[node]
                x, y = now[w], now[rival]
                d = known[node] = _first_difference(x, y, h)
                if d < len(x) and y[d] < x[d]:
                    loser[node], w = w, rival
            node >>= 1
    return out, lengths


def least_ids(lengths: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For merged suffixes (rows) and offsets (columns) the smallest doc_id with the same string.

    A string at an offset is the class of suffixes that share LENGTH - offset codes, and share the
    ``offset`` codes before."""
    n = len(ids)
    out = np.repeat(ids[:, None], REACH + 1, axis=1)
    order = np.argsort(np.ascontiguousarray(left).view(f"S{REACH}").ravel(), kind="stable")
    common = _shared_with_last(left[order])
    for offset in range(REACH + 1):
        here = np.flatnonzero((near <= offset) & (offset <= far))
        if not len(here):
            continue
        right = np.cumsum(lengths < LENGTH - offset)
        before = np.empty(n, np.int64)
        before[order] = np.cumsum(common < offset)
        key = right[here] * (n + 1) + before[here]
        _, inverse = np.unique(key, return_inverse=True)
        least = np.full(inverse.max() + 1, _NO_ID)
        np.minimum.at(least, inverse, ids[here])
        out[here, offset] = least[inverse]
    return out


def merged(pieces: DataFrame, bits: int, parts: int) -> DataFrame:
    """Kind 4: per run and range, suffixes that a smaller doc_id has too, with the smallest by offset."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table in runs(batches, ["part"], together=False):
            part, names = table.column("part")[0].as_py(), table.column("run").to_pylist()
            loaded = [unpack(d.as_py()) for d in table.column("data")]
            texts = [[bytes(r) for r in front_decoded(shared, rest)] for _, shared, rest, _, _ in loaded]
            took, lengths = loser_tree(texts, [x[1].tolist() for x in loaded])
            del texts
            took, sizes = np.array(took), np.array([len(x[1]) for x in loaded])
            ends = np.cumsum(sizes)
            place = np.empty(len(took), np.int64)
            place[np.argsort(took, kind="stable")] = np.arange(len(took))
            side = np.concatenate([x[3].reshape(REACH + 2, -1) for x in loaded], axis=1).T[place]
            ids = np.concatenate([x[4] for x in loaded])[place]
            found = least_ids(np.array(lengths), side[:, :REACH], side[:, REACH], side[:, REACH + 1], ids)
            smaller = np.flatnonzero((found < ids[:, None]).any(axis=1))
            for i, name in enumerate(names):
                mine = smaller[took[smaller] == i]
                if len(mine):
                    number = place[mine] - (ends[i] - sizes[i]) + loaded[i][0][0]
                    yield 4, part, name, pack(number, found[mine].ravel())

    return _dealt(pieces, bits, parts).mapInArrow(lambda batches: _piece_batches(rows(batches)), _PIECES)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remains(marked: DataFrame, answers: DataFrame, bits: int, texts: bool) -> DataFrame:
    """The documents without repeated bytes."""

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["run"], together=False):
            ids, null, docs = _load(table.column("data")[0].as_py())
            found = [unpack(data.as_py()) for data in table.column("data")[1:]]
            run = Run(ids, docs)
            gone = _gone(run, members(run, table.column("marks")[0].as_py(), bits), found)
            for i in range(0, len(docs), 2000):
                out = []
                for doc_id, none, text, start in zip(ids[i : i + 2000].tolist(), null[i : i + 2000], docs[i : i + 2000], run.starts[i : i + 2000], strict=True):
                    here = gone[start : start + len(text)] if gone is not None else None
                    lost = int(here.sum()) if here is not None else 0
                    spans = int(here[0]) + int((here[1:] > here[:-1]).sum()) if lost else 0
                    kept = np.frombuffer(text, np.uint8)[~here].tobytes() if lost else text
                    out.append((None if none else doc_id, len(text), lost, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)

    both = marked.selectExpr("0 AS kind", "-1 AS part", "run", "docs AS data", "marks").unionByName(answers, allowMissingColumns=True)
    dealt = both.repartition("run").sortWithinPartitions("run", "kind", "part")
    return dealt.mapInArrow(results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _gone(run: Run, own: Members | None, found: list[list[np.ndarray]]) -> np.ndarray | None:
    """Which codes of the run's buffer are removed."""
    if own is None:
        return None
    owner = run.owners(own.position)
    answer = np.full(len(own.least), -1)
    told = np.concatenate([numbers for numbers, _ in found]) if found else np.empty(0, np.int64)
    answer[told] = np.arange(len(told))
    answers = np.concatenate([ids for _, ids in found]).reshape(-1, REACH + 1) if found else np.empty((0, REACH + 1), np.int64)
    begins = np.zeros(len(run.codes), bool)
    for offset in range(REACH + 1):
        here = np.flatnonzero((own.near <= offset) & (offset <= own.far))
        which = answer[own.number[here]]
        smallest = own.least[own.number[here]]
        smallest[which >= 0] = answers[which[which >= 0], offset]
        begins[own.position[here[smallest < owner[here]]] - offset] = True
    # A code goes if a repeated string begins at one of the LENGTH places up to it.
    gone = begins.cumsum(dtype=np.int32)
    gone[LENGTH:] -= gone[:-LENGTH].copy()
    return gone > 0


def without_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, least_ranges: int = LEAST_RANGES, texts: bool = True, few_marks: int = FEW_MARKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the remaining bytes."""
    stored = pack_runs(docs, run_bytes)
    total = docs.select(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    bits = (max(least_ranges, -(-total // range_bytes)) - 1).bit_length()
    parts = min(1 << bits, max(least_ranges, -(-total // TASK_BYTES)))
    marked = with_marks(stored, written(shared_cores(core_pieces(stored, bits), bits, parts), "suffix-cores"), few_marks)
    found = written(merged(suffix_pieces(marked, bits), bits, parts), "suffix-answers")
    out = remains(marked, found, bits, texts)
    return out if texts else out.drop("kept")
