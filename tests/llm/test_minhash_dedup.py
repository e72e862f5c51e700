"""MinHash near-dedup against brute force on full sets, and its parts."""

import random

import numpy as np
import pytest

from quire.llm import minhash_dedup as m
from quire.llm.components import components
from tests.llm import cases

DIR = "/root/testdata/sf0.01"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent, width):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders.get(x, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                label[root(i)] = root(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if r not in least or least[r] is None or (d is not None and d < least[r]) else least[r]
    return sorted((str(d), len(s), str(least[root(i)]), d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(n, words, edits, seed, first=1000):
    """Texts that replace up to ``edits`` words of one base text."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(text)))
    return out


def rows_of(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("crowd", "few_ids"), [(4, 0), (m.CROWD, m.FEW_IDS)])
def test_against_brute_force(spark, crowd, few_ids):
    """With crowded groups and without, clustered nodes broadcast and shuffled."""
    rows = [(r[0], r[1]) for r in cases.ROWS]
    rows += family(60, 60, 6, 1) + family(40, 300, 25, 2, 3000) + family(30, 12, 2, 3, 5000)
    got = m.near_groups(frame(spark, rows).repartition(6), 85, 3, crowd, few_ids)
    assert rows_of(got) == brute(rows, 85, 3)


def synthetic(spark, sigs, key=7):
    """Nodes that all share one band."""
    rows = [(i, 100, np.array(x, np.uint64).tobytes(), [key]) for i, x in enumerate(sigs)]
    return spark.createDataFrame(rows, "node long, n long, sig binary, keys array<long>")


def test_unlike_members_of_a_bucket_are_not_compared_in_full(spark, monkeypatch):
    """Members of one band that are not alike have as many rows as there are cells, and a few alike
    ones among them are found."""
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 1 << 63, (1500, 6), dtype=np.uint64) * np.uint64(2)
    for i in range(0, 60, 2):
        sigs[i + 1] = sigs[i] ^ np.array([1 << int(rng.integers(40)), 0, 0, 1 << int(rng.integers(40)), 0, 0], np.uint64)
    dealt = []
    cells = m.in_cells
    monkeypatch.setattr(m, "in_cells", lambda known: dealt.append(cells(known)) or dealt[-1])
    monkeypatch.setattr(m, "_across", None)
    edges = {(min(r), max(r)) for r in m.candidate_edges(synthetic(spark, sigs), 85, crowd=32).collect()}
    assert edges == {(i, i + 1) for i in range(0, 60, 2)}
    assert len(dealt) == 1 and dealt[0].count() <= m.CELLS * len(sigs)


def test_slices_are_linear_in_members(spark):
    """A few members apart from a large part: each slice of members meets them once."""
    known = spark.createDataFrame([(1, i, 5, 0 if i < 990 else i) for i in range(1000)], "cluster long, node long, n long, label long")
    rows = m._across(known, "cluster", 50)
    largest = rows.groupBy("block").count().agg({"count": "max"}).first()[0]
    assert rows.count() == 1000 + 10 * 20 and largest < 110


def test_any_column_names(spark):
    names = ["_hash", "_doc", "_id", "_same", "_times", "_turn", "c0", "first", "same", "a.b"]
    docs = cases.table(spark, extra=False)
    for name in names:
        docs = docs.withColumn(name, m.F.concat(m.F.lit(name), m.F.col("doc_id")))
    got, rows = m.near_dedup(docs), {r.doc_id: tuple(r) for r in docs.collect()}
    assert got.columns == docs.columns and all(tuple(r) == rows[r.doc_id] for r in got.collect()) and got.count() == 9


def test_repeated_rows_without_id(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (None, "seven eight nine ten"), (5, "seven eight nine ten")]
    got = m.near_groups(frame(spark, rows), 85, 3)
    assert rows_of(got) == brute(rows, 85, 3) and m.near_dedup(frame(spark, rows), 85, 3).count() == 2


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(m.near_groups(docs, 85, 3)) == brute(rows, 85, 3)


def test_dedup_keeps_one_of_each(spark):
    docs = cases.table(spark)
    got = m.near_dedup(docs)
    assert got.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids == sorted(["1", "3", "4", "5", "6", "8", "9", "None", "10"])


def test_empty(spark):
    assert m.near_groups(cases.empty(spark)).count() == 0
    assert m.near_dedup(cases.empty(spark)).count() == 0


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.85):
        got = []
        for _ in range(30):
            union = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            both = int(1000 * share)
            a, b = union[: both + (1000 - both) // 2], np.concatenate([union[:both], union[both + (1000 - both) // 2 :]])
            sigs = m.signatures(np.array([m.minima(a), m.minima(b)]))
            got.append(m.estimate(sigs[0], sigs[1]))
        assert abs(np.mean(got) - share) < 0.03


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((999, k) for k in range(900, 930)), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(path, 100), **dict.fromkeys([*range(900, 930), 999], 900)}


def test_bands_follow_the_threshold():
    assert [m.rows_of_bands(p) for p in (85, 80)] == [6, 5] and m.rows_of_bands(5) == 1
    assert all(m.missed(p, m.rows_of_bands(p)) < 3e-7 for p in range(8, 100)) and m.missed(80, 6) > 5e-5
    least = np.arange(3 * m.SIZE, dtype=np.uint64).reshape(3, m.SIZE)
    assert m.band_keys(least, 6).shape == (3, 32) and m.band_keys(least, 5).shape == (3, 38)
