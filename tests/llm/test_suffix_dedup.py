"""Removal of repeated passages against brute force, and the parts of the merge sort."""

import hashlib
import random

import numpy as np
import pytest

from quire.llm import suffix_dedup as s
from tests.llm import cases

DIR = "/root/testdata/sf0.01"


def brute(rows, length=s.LENGTH):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings."""
    data = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: (d is None, d or 0)
    least = {}
    for d, b in data:
        for i in range(len(b) - length + 1):
            w = hash(b[i : i + length])
            if w not in least or key(d) < least[w]:
                least[w] = key(d)
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if least[hash(b[i : i + length])] < key(d):
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    rows = s.without_repeats(df, texts=False, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def tricky():
    rng = random.Random(4)
    text = lambda n, letters="abcdefghij ": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 80, 200)]
    rows = [(r[0], r[1]) for r in cases.ROWS]
    for i in range(120):
        parts = [text(rng.randrange(60)), rng.choice(shared), text(rng.randrange(30)), rng.choice(shared)[rng.randrange(20) :]]
        rows.append((100 + rng.randrange(90), "".join(parts)))
    rows += [(300 + i, "ab" * rng.randrange(20, 60)) for i in range(10)] + [(320 + i, "z" * (40 + 3 * i)) for i in range(10)]
    rows += [(340 + i, "é漢" * 12 + text(20) + "\x00" * 60 + text(3, "xy")) for i in range(6)]
    return rows


@pytest.mark.parametrize(("run_bytes", "ranges", "few_marks"), [(3000, 8, 0), (3000, 128, s.FEW_MARKS), (s.RUN_BYTES, 8, s.FEW_MARKS)])
def test_against_brute_force(spark, run_bytes, ranges, few_marks):
    """With answers shuffled and broadcast, few and many runs and ranges."""
    rows = tricky()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, run_bytes=run_bytes, least_ranges=ranges, few_marks=few_marks) == brute(rows)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs.repartition(3), run_bytes=300_000, range_bytes=100_000) == brute(rows)
    assert got(docs) == brute(rows)


def test_very_long_texts(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    one, two = text(400_000), text(300_000)
    rows = [(1, one), (2, two + one[1000:200_000] + two[:90_000]), (3, "ab" * 500_000), (4, "b" + "ab" * 100)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), run_bytes=200_000) == brute(rows)


def test_remaining_bytes(spark):
    rows = s.without_repeats(cases.table(spark)).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert {r.doc_id: r.kept for r in rows}[7] == b""


def test_empty(spark):
    assert s.without_repeats(cases.empty(spark)).count() == 0


def test_front_coding_round_trip():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, s.LENGTH)).astype(np.uint8)
    rows[:, :20] = 1
    rows = rows[np.lexsort(rows.T[::-1])]
    shared, rest = s.front_coded(rows)
    assert (s.front_decoded(shared, rest) == rows).all() and len(rest) < rows.size * 2 / 3


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(1, 60))) for _ in range(k)]
    common = lambda a, b: next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    shared = [[0, *(common(a, b) for a, b in zip(r, r[1:], strict=False))] for r in runs]
    took, lengths = s.loser_tree(runs, shared)
    at, out = [0] * k, []
    for w in took:
        out.append(runs[w][at[w]])
        at[w] += 1
    assert out == sorted(x for r in runs for x in r)
    assert lengths == [0, *(common(a, b) for a, b in zip(out, out[1:], strict=False))]


def test_known_prefixes_are_not_compared(monkeypatch):
    """A byte of a run's text is read once as its own and at most once for each place that it loses."""
    read, plain = [], s._first_difference

    def counted(x, y, known):
        d = plain(x, y, known)
        read.append(min(d + 1, len(x)) - known)
        return d

    monkeypatch.setattr(s, "_first_difference", counted)
    runs = [sorted(b"p" * 40 + bytes([i, j]) for j in range(60)) for i in range(8)]
    shared = [[0] + [41] * 59 for _ in runs]
    s.loser_tree(runs, shared)
    assert sum(read) <= 8 * 42 + 2 * 8 * 60
