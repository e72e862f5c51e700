"""Near-duplicate components by b-bit MinHash.

A document's set holds the 64-bit hashes of its distinct word shingles. ``SIZE`` minima of each set
make band keys; afterwards only the low ``BITS`` bits of each minimum are kept, packed into a
signature. Documents with equal sets are one node, so copies never meet in a bucket.

1. Buckets: nodes that share a band key. Inside a bucket, signatures are compared by bit counts; the
   share of equal fields, corrected for fields that collide by chance, estimates the similarity. A
   bucket emits only a spanning forest of the pairs whose estimate is at most ``MARGIN`` standard
   errors below the threshold: as many edges as members, however many pairs there are.
2. Clusters: components of those forests. Every candidate pair lies inside one cluster, and each node
   in one cluster, so the texts of clustered nodes are shuffled once.
3. Confirmation: inside a cluster, full sets are compared through an inverted index; again only a
   spanning forest of the confirmed links is emitted, and its components are the result.

Groups of more than ``crowd`` members are split into blocks that share a hub, so that alike members
are linked through it. A bucket that its blocks leave apart is dealt anew by ``CELLS`` further keys,
each of ``CELL_FIELDS`` fields of the signatures: members that are not alike fall into different cells,
so a member has at most ``CELLS`` rows however large the bucket is. What is left apart in a cell or a
cluster of more than ``crowd`` members is compared in full, in blocks of queries against slices of
members; queries are the members outside the group's largest part, as any link between two parts has
an end there. No pairs are emitted, nothing is dropped or capped.

Bands have as many rows as leave a pair at the threshold without a common band with probability
below 3e-7: 32 bands of 6 rows at 0.85 (2.6e-7), 38 of 5 at 0.8 (2.8e-7). Below a threshold of 0.08
even bands of one row miss more. Cells add to that only for pairs whose common bands are all crowded
and left apart; such a pair has ``CELLS`` chances in each of them, each with other fields.

Defined results: null counts as empty; a text without words has an empty set, is linked with nothing
and stays; fewer words than a shingle make one shingle; very long texts have their whole sets compared;
a null doc_id counts as larger than any, and a component of null ids has a null component_id; ties
between equal doc_ids are decided by the order of rows; rows that repeat a doc_id are separate
documents, of which ``near_dedup`` keeps one of each component; an empty table gives an empty result;
other columns are ignored by ``near_groups`` and carried unchanged, whatever their names, by
``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.components import components
from quire.llm.shared import runs, text_or_empty, with_hot_key, written

SIZE = 192
#: Most probability that a pair at the threshold shares no band.
MISSED = 3e-7
BITS = 2
#: Standard errors of the estimate that a candidate may fall short of the threshold.
MARGIN = 5.5
#: Members of a group that are compared in one block.
CROWD = 128
#: Further keys of a member of a crowded bucket, and the fields of a signature that make one.
CELLS, CELL_FIELDS = 16, 8
#: Shingles of a group that one task indexes.
CROWD_SHINGLES = 1 << 21
#: Clustered nodes up to this number (some 20 MB) may be broadcast; with more, a shuffle joins them.
FEW_IDS = 250_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_ODD_BITS = np.uint64(0x5555555555555555)
_FACTORS = np.random.default_rng(20240501).integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S33)


class WordHashes(dict):
    """64-bit hashes of words; forgotten when they grow too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: bytes, words: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    width_here = min(width, len(hashes))
    last = len(hashes) - width_here + 1
    found = np.full(last, np.uint64(width_here))
    for i in range(width_here):
        found = _mix(found ^ hashes[i : i + last])
    return np.unique(found)


def minima(found: np.ndarray, step: int = 256) -> np.ndarray:
    """The least value of each of SIZE hash functions over a set."""
    least = np.full(SIZE, np.uint64(2**64 - 1))
    for i in range(0, len(found), step):
        np.minimum(least, (found[i : i + step, None] * _FACTORS).min(axis=0), out=least)
    return least


def missed(percent: int, rows: int) -> float:
    """Probability that a pair at the threshold shares no band of so many rows."""
    return (1 - (percent / 100) ** rows) ** (SIZE // rows)


def rows_of_bands(percent: int) -> int:
    """The most rows of a band with which a pair at the threshold is missed at most by MISSED."""
    return max((r for r in range(1, SIZE + 1) if missed(percent, r) <= MISSED), default=1)


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """Rows of minima to rows of band keys; minima that fill no band are left out."""
    bands = SIZE // rows
    parts = least[:, : bands * rows].reshape(len(least), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(least), bands)).copy()
    for i in range(rows):
        key = _mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def signatures(least: np.ndarray) -> np.ndarray:
    """Rows of minima to rows of packed low bits, 64 / BITS minima in a word."""
    low = _mix(least) & np.uint64((1 << BITS) - 1)
    per_word = 64 // BITS
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(len(least), SIZE // per_word, per_word) << shifts).sum(axis=2, dtype=np.uint64)


def mismatches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Fields in which a signature differs from each of many, by bit counts."""
    x = one ^ many
    return np.bitwise_count((x | (x >> np.uint64(1))) & _ODD_BITS).sum(axis=-1, dtype=np.int64)


def most_mismatches(percent: int) -> int:
    """Differing fields of the lowest estimate that is still a candidate.

    With collision share c = 2**-BITS, fields agree with probability c + (1 - c) * J."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * percent / 100
    return int(SIZE * (1 - agree) + MARGIN * np.sqrt(SIZE * agree * (1 - agree)))


def estimate(one: np.ndarray, other: np.ndarray) -> float:
    """Similarity estimated from two signatures, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (1 - mismatches(one, other) / SIZE - chance) / (1 - chance)


def forest(size: int, linked_with: Callable[[int], np.ndarray], parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``size`` members; ``linked_with`` gives all links of one.

    Members of equal ``parts`` count as linked already: only edges between parts are given."""
    label = np.arange(size) if parts is None else np.unique(parts, return_inverse=True)[1]
    done, edges = np.zeros(size, bool), []
    main = -1 if parts is None else np.bincount(label).argmax()
    while (left := np.flatnonzero(~done & (label != main))).size:
        i = left[0]
        done[i] = True
        found = linked_with(i)
        found = found[label[found] != label[i]]
        if found.size:
            others, at = np.unique(label[found], return_index=True)
            edges += [(i, int(found[k])) for k in at]
            label[np.isin(label, others)] = label[i]
        main = np.bincount(label).argmax()
    return edges


class Index:
    """An inverted index of sets: which sets have at least ``percent`` similarity with a given one."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sizes, self.percent = np.array([len(s) for s in sets], np.int64), percent
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.vocabulary, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))

    def linked(self, found: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary) or not len(found):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == found]
        start, length = self.first[at], self.first[at + 1] - self.first[at]
        total = int(length.sum())
        where = np.repeat(start - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(total)
        common = np.bincount(self.owners[where], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= self.percent * (len(found) + self.sizes - common))


_SIGNED = "rid long, doc_id long, same long, n long, print binary, sig binary, keys array<long>"


def signed(docs: DataFrame, percent: int, width: int = 3) -> DataFrame:
    """A row per document: id, set size and fingerprint, and in the task's first row of each set its
    signature and band keys; written to the shared folder."""
    in_band = rows_of_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for batch in batches:
            sizes, prints, fresh, least = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = shingle_set(text.as_py(), words, width)
                mark = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                sizes.append(len(found))
                prints.append(mark)
                if mark is not None and mark not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(mark)
                    fresh.append(i)
                    least.append(minima(found))
            sigs, keys = [None] * len(sizes), [None] * len(sizes)
            if fresh:
                rows = np.array(least)
                for i, sig, key in zip(fresh, signatures(rows), band_keys(rows, in_band), strict=True):
                    sigs[i], keys[i] = sig.tobytes(), key
            columns = [batch.column("rid"), batch.column("doc_id"), batch.column("same"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "same", "n", "print", "sig", "keys"])

    text = text_or_empty()
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.cast("binary").alias("text"))
    return written(source.mapInArrow(run, _SIGNED), "minhash-rows")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _in_blocks(rows: DataFrame, group: str, blocks: str, hub: str) -> DataFrame:
    """Deal the members of each group into its number of blocks; the hub is in all of them."""
    mine = F.array(F.pmod(F.xxhash64("node"), F.col(blocks)))
    all_of_them = F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    dealt = rows.withColumn("block", F.explode(F.when((F.col(blocks) > 1) & (F.col("node") == F.col(hub)), all_of_them).otherwise(mine)))
    return dealt.repartition(group, "block").sortWithinPartitions(group, "block", F.col("node") != F.col(hub), "node")


def _apart(rows: DataFrame, group: str, edges: DataFrame) -> DataFrame:
    """The rows of groups that the edges leave in several parts, with the label of their part."""
    labels = components(edges)
    known = written(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "minhash-labelled")
    several = known.groupBy(group).agg((F.min("label") < F.max("label")).alias("_several"))
    # A group may hold a third of all rows, so facts about groups are salted.
    return with_hot_key(known, several, [group], "node").where("_several").drop("_several")


def _across(known: DataFrame, group: str, crowd: int, crowd_shingles: int = CROWD_SHINGLES) -> DataFrame:
    """Queries against members: ``known`` has labelled groups in several parts. A block of queries
    (members outside the group's largest part) meets each slice of members, queries first."""
    counts = known.groupBy(group, "label").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_size"))
    main = F.max_by(F.struct("label", "_n", "_size"), F.struct("_n", "label"))
    about = counts.groupBy(group).agg(main.alias("_m"), F.sum("_n").alias("_n"), F.sum("_size").alias("_size"))
    blocks = F.greatest(F.ceil((F.col("_n") - F.col("_m._n")) / crowd), F.ceil((F.col("_size") - F.col("_m._size")) / crowd_shingles))
    about = about.select(group, F.col("_m.label").alias("_main"), blocks.cast("long").alias("_blocks"), F.ceil(F.col("_n") / crowd).cast("long").alias("_slices"))
    place = lambda block, slice_, query: F.struct((block * F.col("_slices") + slice_).alias("block"), F.lit(query).alias("query"))
    own_block, own_slice = F.pmod(F.xxhash64("node"), F.col("_blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("_slices"))
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    query = F.transform(all_of("_slices"), lambda s: place(own_block, s, True))
    member = F.transform(all_of("_blocks"), lambda b: place(b, own_slice, False))
    dealt = with_hot_key(known, about, [group], "node").withColumn("_to", F.explode(F.when(F.col("label") != F.col("_main"), F.concat(query, member)).otherwise(member)))
    return dealt.select("*", "_to.block", "_to.query").drop("_to", "_main", "_blocks", "_slices")


def _queries_first(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "block").sortWithinPartitions(group, "block", F.desc("query"))


def _new_links(held: set, label: int, others: np.ndarray, node: int, nodes: np.ndarray) -> list[tuple[int, int]]:
    """One edge for each pair of labels that a query links for the first time in its block."""
    out = []
    for other, at in zip(*np.unique(others, return_index=True), strict=True):
        if (pair := (min(label, other), max(label, other))) not in held and label != other:
            held.add(pair)
            out.append((node, int(nodes[at])))
    return out


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


@lru_cache(maxsize=4096)
def _cell_fields(key: int) -> np.ndarray:
    """Which fields make the cells of a bucket: rows of CELL_FIELDS numbers."""
    at = np.arange(CELLS * CELL_FIELDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (_mix(at ^ np.array([key], np.int64).view(np.uint64)) % np.uint64(SIZE)).astype(np.int64).reshape(CELLS, CELL_FIELDS)


def in_cells(known: DataFrame) -> DataFrame:
    """Labelled members of crowded buckets, once for each of their cells, which take the key's place."""
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    weights = (np.uint64(1) << (np.arange(CELL_FIELDS, dtype=np.uint64) * np.uint64(BITS)))[None, :]
    number = np.arange(1, CELLS + 1, dtype=np.uint64) << np.uint64(BITS * CELL_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = ((_sig_matrix(batch.column("sig"))[:, :, None] >> shifts) & np.uint64((1 << BITS) - 1)).reshape(batch.num_rows, SIZE)
            keys = batch.column("key").to_numpy()
            made = np.empty((batch.num_rows, CELLS), np.uint64)
            for i, key in enumerate(keys):
                made[i] = (fields[i][_cell_fields(int(key))] * weights).sum(axis=1, dtype=np.uint64) + number
            made = _mix(made ^ keys.view(np.uint64)[:, None]).view(np.int64)
            same = pa.array(np.repeat(np.arange(batch.num_rows), CELLS))
            yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), *(batch.column(c).take(same) for c in ("node", "n", "sig", "label"))], ["key", "node", "n", "sig", "label"])

    return known.select("key", "node", "n", "sig", "label").mapInArrow(run, "key long, node long, n long, sig binary, label long")


def candidate_edges(nodes: DataFrame, percent: int, crowd: int = CROWD) -> DataFrame:
    """Spanning forests of the candidates of each bucket."""
    most = most_mismatches(percent)
    bands = nodes.select("node", F.explode("keys").alias("key"))
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.min("node").alias("hub")).where("_m > 1")
    full = full.withColumn("blocks", F.ceil(F.col("_m") / crowd).cast("long")).drop("_m")
    met = written(bands.join(full, "key").join(nodes.select("node", "n", "sig"), "node"), "minhash-buckets")

    def near(n: np.ndarray, sig: np.ndarray, size: int, one: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(n, size) >= percent * np.maximum(n, size)
        return np.flatnonzero(fits & (mismatches(one, sig) <= most))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in runs(batches, ["key", "block"]):
            out = []
            node, n, sig = tables.column("node").to_numpy(), tables.column("n").to_numpy(), _sig_matrix(tables.column("sig"))
            bounds = tables.column("run").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(bounds)) + 1, len(bounds))
            starts = np.append(0, ends[:-1])
            label = tables.column("label").to_numpy()
            two = starts[ends - starts == 2]
            close = (mismatches(sig[two], sig[two + 1]) <= most) & (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])) & (label[two] != label[two + 1])
            out += list(zip(node[two[close]].tolist(), node[two[close] + 1].tolist(), strict=True))
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2:
                    out += [(node[s + i], node[s + k]) for i, k in forest(e - s, lambda i, s=s, e=e: near(n[s:e], sig[s:e], n[s + i], sig[s + i]), label[s:e])]
            if out:
                yield _edges(out)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, label, n, sig, held = None, [], [], [], [], set()
        for table in runs(batches, ["key", "block", "query"], whole=False):
            place, rows = (table.column("key")[0].as_py(), table.column("block")[0].as_py()), [table.column(c).to_numpy() for c in ("node", "label", "n")]
            if place != now:
                now, node, label, n, sig, held = place, [], [], [], [], set()
            if table.column("query")[0].as_py():
                node, label, n = ([*old, *new] for old, new in zip((node, label, n), rows, strict=True))
                sig += list(_sig_matrix(table.column("sig")))
                continue
            out, members = [], _sig_matrix(table.column("sig"))
            for i in range(len(node)):
                found = near(rows[2], members, n[i], sig[i])
                out += _new_links(held, label[i], rows[1][found], node[i], rows[0][found])
            if out:
                yield _edges(out)

    in_blocks = lambda rows: _in_blocks(rows, "key", "blocks", "hub").select("key", "block", "node", "label", "n", "sig").mapInArrow(compare, "a long, b long")
    edges = written(in_blocks(met.withColumn("label", F.col("node"))).distinct(), "minhash-candidates")
    crowded = met.where("blocks > 1")
    if crowded.isEmpty():
        return edges
    cells = written(in_cells(_apart(crowded, "key", edges)), "minhash-cells")
    full = cells.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.min("node").alias("hub"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi")
    full = full.withColumn("blocks", F.ceil(F.col("_m") / crowd).cast("long")).drop("_m", "_lo", "_hi")
    met = written(cells.join(full, "key"), "minhash-in-cells")
    edges = written(edges.union(in_blocks(met)).distinct(), "minhash-candidates")
    crowded = met.where("blocks > 1").drop("label")
    if crowded.isEmpty():
        return edges
    rest = _queries_first(_across(_apart(crowded, "key", edges), "key", crowd), "key")
    more = rest.select("key", "block", "query", "node", "label", "n", "sig").mapInArrow(across, "a long, b long")
    return written(edges.union(more).distinct(), "minhash-candidates")


def confirmed_edges(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, percent: int, width: int, crowd: int = CROWD, crowd_shingles: int = CROWD_SHINGLES, few_ids: int = FEW_IDS) -> DataFrame:
    """Spanning forests of the links of each cluster, confirmed on full sets."""
    sized = clusters.withColumnRenamed("label", "cluster").join(nodes.select("node", "n", "doc_id", "same"), "node")
    about = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / crowd), F.ceil(F.sum("n") / crowd_shingles)).cast("long").alias("blocks"), F.min("node").alias("hub"))
    wanted = written(sized.join(about, "cluster"), "minhash-clusters")
    text = text_or_empty()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_same"), text.cast("binary").alias("text"))
    ids = F.broadcast(wanted) if wanted.count() <= few_ids else wanted
    met = texts.join(ids, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_same") == F.col("same"))).drop("_id", "_same", "same", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for table in runs(batches, ["cluster", "block"], together=False):
            node = table.column("node").to_numpy()
            sets = [shingle_set(t.as_py(), words, width) for t in table.column("text")]
            index = Index(sets, percent)
            out = [(node[i], node[k]) for i, k in forest(len(sets), lambda i: index.linked(sets[i])) if node[i] != node[k]]
            if out:
                yield _edges(out)

    dealt = _in_blocks(met, "cluster", "blocks", "hub").select("cluster", "block", "node", "text")
    edges = written(dealt.mapInArrow(compare, "a long, b long"), "minhash-links")
    large = wanted.where("blocks > 1")
    if large.isEmpty():
        return edges
    # Texts join what is left apart by node.
    placed = _across(_apart(large, "cluster", edges), "cluster", crowd, crowd_shingles).select("cluster", "block", "query", "node", "label")
    large_texts = written(met.where("blocks > 1").select("node", "text").dropDuplicates(["node"]), "minhash-large")
    across_rows = _queries_first(placed.join(large_texts, "node"), "cluster")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        now, node, label, sets, index, held = None, [], [], [], None, set()
        for table in runs(batches, ["cluster", "block", "query"], whole=False):
            place = (table.column("cluster")[0].as_py(), table.column("block")[0].as_py())
            if place != now:
                now, node, label, sets, index, held = place, [], [], [], None, set()
            nodes_here, labels_here = table.column("node").to_numpy(), table.column("label").to_numpy()
            if table.column("query")[0].as_py():
                node, label = [*node, *nodes_here], [*label, *labels_here]
                sets += [shingle_set(t.as_py(), words, width) for t in table.column("text")]
                continue
            if index is None:
                index, node, label = Index(sets, percent), np.array(node), np.array(label)
            out = []
            for other, other_label, text in zip(nodes_here, labels_here, table.column("text"), strict=True):
                found = index.linked(shingle_set(text.as_py(), words, width))
                out += _new_links(held, other_label, label[found], int(other), node[found])
            if out:
                yield _edges(out)

    more = across_rows.select("cluster", "block", "query", "node", "label", "text").mapInArrow(across, "a long, b long")
    return written(edges.union(more), "minhash-links")


def _grouped(docs: DataFrame, percent: int, width: int, crowd: int, few_ids: int) -> DataFrame:
    """rid, doc_id, same, n, component_id and ``first``: whether the row is its component's least."""
    rows = signed(docs, percent, width)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    best = F.min_by(F.struct("rid", "doc_id", "same"), order)
    nodes = rows.where("print IS NOT NULL").groupBy("print").agg(best.alias("best"), F.max(F.struct("sig", "keys")).alias("made"), F.first("n").alias("n"))
    nodes = written(nodes.select("print", F.col("best.rid").alias("node"), "best.doc_id", "best.same", "n", "made.sig", "made.keys"), "minhash-nodes")
    clusters = components(candidate_edges(nodes, percent, crowd))
    labels = components(confirmed_edges(docs, nodes, clusters, percent, width, crowd, few_ids=few_ids))
    known = nodes.select("print", "node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("least"))
    facts = known.join(least, "label").select("print", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("first_rid"))
    placed = with_hot_key(rows.where("print IS NOT NULL").select("rid", "doc_id", "same", "n", "print"), facts, ["print"], "rid")
    alone = rows.where("print IS NULL").select("rid", "doc_id", "same", "n", F.lit(None).cast("binary").alias("print"), F.col("doc_id").alias("component_id"), F.col("rid").alias("first_rid"))
    return placed.unionByName(alone).withColumn("first", F.col("rid") == F.col("first_rid"))


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5, crowd: int = CROWD, few_ids: int = FEW_IDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    found = _grouped(docs, percent, width, crowd, few_ids)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 80, width: int = 5, crowd: int = CROWD, few_ids: int = FEW_IDS) -> DataFrame:
    """One document of each component, all columns unchanged."""
    stay = written(_grouped(docs, percent, width, crowd, few_ids).where("first").select("doc_id", "same"), "minhash-stay")
    stay = stay.groupBy(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).agg(F.count(F.lit(1)).alias("_times"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = rows.select(*names, F.xxhash64(text_or_empty(text)).alias("_hash"), F.col(doc_id).cast("long").alias("_doc"))
    met = rows.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_same")))
    turn = F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy("_doc"))
    return met.withColumn("_turn", turn).where("_turn <= _times").select(*names).toDF(*docs.columns)
