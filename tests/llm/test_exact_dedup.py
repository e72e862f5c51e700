"""Exact dedup: the index, the groups and the deduplicated table."""

import hashlib
import re

import pytest

from quire.llm import exact_dedup as x
from quire.llm.exact_dedup import Directory, exact_dedup, exact_groups
from tests.llm import cases


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for norm, members in groups.items():
        keep, first = min(members, key=lambda m: m[:3])[3], True
        for m in sorted(members, key=lambda m: m[:3]):
            want.append((m[3], keep, len(members), m[3] == keep and first, hashlib.sha256(norm.encode()).hexdigest()))
            first = first and m[3] != keep
    return want


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("capacity", "key_bits", "held"), [(1, 64, 0), (256, 64, x.HELD_BYTES), (4, 16, 100), (1, 2, x.HELD_BYTES), (2, 1, 0)])
def test_groups(spark, capacity, key_bits, held):
    """Short keys put different texts into one chain; bytes tell them apart."""
    rows = cases.ROWS + [(100 + i, f"text {i % 37}", "en", "a", 1) for i in range(300)]
    got = exact_groups(cases.table(spark, rows).repartition(5), capacity, 200, key_bits, held).collect()
    assert (max(r.chain for r in got) > 0) == (key_bits < 16)
    assert order([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got]) == order(brute(rows))


def test_dedup_keeps_columns(spark):
    docs = cases.table(spark)
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    kept = [(d, t) for d, t in ((r[0], r[1]) for r in cases.ROWS)]
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    assert ids == sorted((d if d is not None else -1) for d, _, _, k, _ in brute(cases.ROWS) if k)
    assert len(kept) == len(cases.ROWS)


def test_one_key_for_two_texts(spark):
    """Two texts that share all 16 bits of their key are kept apart, in the build and by a probe."""
    seen, i = {}, 0
    while (key := x._key(hashlib.sha256(b"text%d" % i).digest(), 16)) not in seen:
        seen[key] = i
        i += 1
    docs = spark.createDataFrame([(1, f"text{seen[key]}"), (2, f"text {i}"), (3, f"text{i}"), (4, f"text {seen[key]}")], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_groups(docs.repartition(2), key_bits=16).collect()}
    assert [got[d].keep_id for d in (1, 2, 3, 4)] == [4, 2, 2, 4] and {r.chain for r in got.values()} == {0, 1}
    index = x.build_index(x.make_heap(docs.where("doc_id <> 1"), [], 16), key_bits=16)
    found = {r.doc_id: r.text_ref for r in x.probe(index, docs.union(spark.createDataFrame([(5, "other"), (None, None)], docs.schema))).collect()}
    assert found[1] == found[4] != found[2] == found[3] and found[5] is None and found[None] is None


def test_buckets_are_stored(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    index = x.build_index(x.make_heap(docs, []), capacity=3)
    rows = index.buckets.collect()
    sizes = {}
    for r in rows:
        key = r.key & (1 << 64) - 1
        assert key >> (64 - r.bucket_depth) == r.owner << (r.bucket_depth - index.depth) | r.bucket
        sizes.setdefault((r.owner, r.bucket_depth, r.bucket), set()).add(key)
    assert len(rows) == 500 and max(map(len, sizes.values())) <= 3
    dealt = index.dealt(x._texts(index.heap, False)).groupBy(x.F.spark_partition_id()).count().collect()
    assert len(dealt) == index.parts and max(r["count"] for r in dealt) < 2 * 500 / index.parts


def test_any_column_names(spark):
    names = ["rid", "key", "ref", "size", "n", "id", "c0", "c1", "text_ref", "owner", "_digest", "_turn", "_stay", "_sha", "a.b"]
    docs = cases.table(spark, extra=False).select("*", *[x.F.concat(x.F.lit(f"{c} "), "doc_id").alias(c) for c in names])
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in got.collect()) and exact_groups(docs).count() == docs.count()


def test_very_long_text(spark):
    text = "ab c" * 500_000
    docs = spark.createDataFrame([(1, text), (2, text.replace(" ", "")), (3, text + "d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_groups(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_empty_table(spark):
    assert exact_groups(cases.empty(spark)).count() == 0
    assert exact_dedup(cases.empty(spark)).count() == 0


def test_directory_splits_and_chains():
    directory = Directory(capacity=2, hash_bits=6)
    entries = [directory.insert(k % 64, b"%d" % k, k) for k in range(200)]
    assert entries == list(range(200))
    assert [directory.insert(k % 64, b"%d" % k, None) for k in range(200)] == entries
    for bucket in directory.buckets():
        assert len(bucket.chains) <= 2
        assert all(key >> (6 - bucket.depth) == bucket.prefix for key in bucket.chains)
    assert directory.depth == 5 and len(directory.slots) == 32


def test_overflow_at_full_depth():
    directory = Directory(capacity=1, hash_bits=2)
    for body in (b"a", b"b", b"c"):
        directory.insert(3, body, body)
    assert len(directory.find(3).chains[3]) == 3
