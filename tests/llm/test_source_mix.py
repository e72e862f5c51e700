"""Mixing against a direct computation."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm.source_mix import mix, mixed_documents, targets
from tests.llm import cases


def brute_targets(sizes):
    """Share by weight, fix what is above its cap, share the rest anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if w else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def brute(rows):
    docs = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _, s, _ in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = brute_targets(sizes), []
    for s, size in sizes.items():
        own = sorted(((int(hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:15], 16), d if d is not None else -1, n, d) for d, x, n in docs if x == s))
        budget, at = int(goal[s] + 0.5), 0
        for _, _, n, d in own:
            taken = (budget // size * n + max(0, min(n, budget % size - at))) if size else 0
            out.append((d, n, size, round(goal[s], 6), taken))
            at += n
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_awkward_rows(spark):
    assert shown(mix(cases.table(spark))) == brute(cases.ROWS)


def test_many_ranges(spark):
    rows = [(i, "w " * (i % 23), "en", f"s{min(i % 40, 9)}" if i % 11 else None, 0) for i in range(3000)]
    got = shown(mix(cases.table(spark, rows, False), range_rows=5))
    assert got == brute(rows)
    taken, goal = {}, {}
    for row, (d, n, size, target, t) in zip(rows, sorted(got), strict=True):
        taken[row[3]] = taken.get(row[3], 0) + t
        goal[row[3]] = target
        assert t <= 3 * n
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)


def test_documents_follow_the_mix(spark):
    docs = cases.table(spark)
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    want = sum((2 * t + n) // (2 * n) for _, n, _, _, t in brute(cases.ROWS) if n)
    assert got.count() == want


def test_any_column_names(spark):
    docs = cases.table(spark, cases.ROWS + [(None, "no id here", "en", "c", 1)], extra=False)
    for name in ("_n", "_copies", "_copy", "_id", "_doc", "_row", "_turn", "_size", "c0", "c1", "taken", "a.b"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.lit(" of "), F.coalesce("text", F.lit("none"))))
    got = mixed_documents(docs)
    rows = {tuple(map(str, r)) for r in docs.collect()}
    assert got.columns == docs.columns and {tuple(map(str, r)) for r in got.collect()} <= rows
    assert got.count() == mixed_documents(docs.select("doc_id", "text", "source")).count() > 0


def test_empty_table(spark):
    assert mix(cases.empty(spark)).count() == 0
    assert mixed_documents(cases.empty(spark)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(min_size=1, max_size=3)), st.integers(0, 10**6), min_size=1, max_size=12))
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert all(abs(r.target - want[r.source]) <= 1e-6 * max(1, r.target) for r in got) and len(got) == len(sizes)
