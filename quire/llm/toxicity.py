"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of three lexicons (a fixed seed list, and words and word stems
mined from labelled rows by their log-odds), how many hits stand near a second-person pronoun, and
the rates of capitals, exclamation and question marks, and obfuscated spellings. Language, source,
doc_id and labels are no features.

The fit takes a bounded sample: the ``sample`` labelled training rows of least hash. Training rows
are those whose crc32(doc_id as text) is not divisible by five; that remainder also makes four folds.
A training row's lexicon features come from lexicons mined without its fold and the calibration
from trees fitted without it, so neither sees its own label. Only the counts of the sample's terms that
are above the odds, and its feature rows, reach the driver. Scoring is one Arrow map over all rows.

Defined results: null counts as the empty text and gets a score like any other; very long texts are
read whole, all features being counts and rates; a text's score does not depend on other rows scored,
so repeated rows score alike; ties between splits go to the first feature and cut; label rows with null toxic are ignored and repeated ones count
once, toxic if any is; without both classes every score is the share of toxic labels (0 without
labels); a null doc_id is never held out and has no label; an empty table gives an empty result;
columns other than doc_id and text are ignored by ``score`` and kept by ``not_toxic``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Trees, fit_isotonic, fit_trees, sigmoid
from quire.llm.shared import text_or_empty, written

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
FOLDS = 5
LEAST_DOCS = 4
LEAST_ODDS = 2.5
NEAR = 5

SEED_WORDS = frozenset("idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting dumb imbecile fool filth garbage vermin clown idiota estúpido estúpida imbécil basura idiote stupide crétin ordure idiotisch dumm dummkopf abschaum müll".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestra vuestro".split())

_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_OBFUSCATED = re.compile(r"[^\W\d_][*@$!|#0134579._-]+[^\W\d_]")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))

WORD, STEM, SEED, YOU, OBFUSCATED, DISGUISED, SHOUT = (1 << i for i in range(7))
N_FEATURES = 15


def stems(word: str) -> list[str]:
    """The terms of a word: itself and its first four to six letters."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def bare(word: str) -> str:
    return _STRIP.sub("", word.lower())


class Codes(dict):
    """What is known of a raw word, by bits; forgotten when it grows too large."""

    def __init__(self, lexicon: frozenset[str], most: int = 300_000) -> None:
        self.lexicon, self.most = lexicon, most

    def __missing__(self, raw: str) -> int:
        word, code = bare(raw), 0
        code |= YOU * (word in SECOND_PERSON) | SEED * (word in SEED_WORDS) | SHOUT * (len(word) > 1 and raw.isupper())
        code |= WORD * (word in self.lexicon)
        code |= STEM * any(t in self.lexicon for t in stems(word)[1:])
        if _OBFUSCATED.search(raw):
            code |= OBFUSCATED
            plain = re.sub(r"[\W_]", "", word.translate(_LEET))
            starred = re.sub(r"[\W\d_]", "", word)
            code |= DISGUISED * any(w in SEED_WORDS or w in self.lexicon for w in (plain, starred))
        if len(self) >= self.most:
            self.clear()
        self[raw] = code
        return code


def features(text: str, codes: Codes) -> list[float]:
    """The dense features of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    data = text.encode("utf-8", "replace")
    size = len(data)
    rest, letters = size - len(data.translate(None, _UPPER)), size - len(data.translate(None, _LETTERS))
    count = lambda bit: int(np.count_nonzero(code & bit))
    hit = (code & (WORD | STEM | SEED | DISGUISED)) > 0
    hits = int(hit.sum())
    near = 0
    if hits and (you := np.nonzero(code & YOU)[0]).size:
        at = np.nonzero(hit)[0]
        after = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(after, you.size - 1)]), np.abs(at - you[np.maximum(after - 1, 0)]))
        near = int((gap <= NEAR).sum())
    marks = data.count(b"!") + data.count(b"?")
    counts = [count(b) for b in (WORD, STEM, SEED, DISGUISED)]
    return [
        *(c / n for c in counts),
        float(np.log1p(hits)),
        hits / n,
        counts[0],
        counts[2],
        near / n,
        near / max(hits, 1),
        rest / max(letters, 1),
        count(SHOUT) / n,
        marks / n,
        count(OBFUSCATED) / n,
        float(np.log1p(n)),
    ]


@dataclass
class Model:
    """A lexicon, trees and a calibration; ``share`` alone where nothing could be fitted."""

    share: float
    lexicon: frozenset[str] = frozenset()
    trees: Trees | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        """Scores; a thousandth of the raw one keeps the order inside flat steps."""
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * sigmoid(raw)


def remainder(column: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo five."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(FOLDS)), F.lit(1)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fold, toxic and text of the sampled training rows, written to the shared folder."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", remainder())
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = rows.where("fold <> 0").join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # The sample is bounded by a parameter, so it may be broadcast.
    return written(texts.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")


def _log_odds(toxic: Column, other: Column, all_toxic: int, all_other: int) -> Column:
    return F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((other + 0.5) / (all_other + 1))


def term_counts(rows: DataFrame, totals: dict[int, tuple[int, int]]) -> list:
    """The toxic and other training rows of each fold that hold a term, for all terms that some
    lexicon may hold: those whose odds, with all folds or without one, are not far from the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            keys = list(held)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [held[k][0] for k in keys], [held[k][1] for k in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["term", "fold", "other", "toxic"])

        for batch in batches:
            for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True):
                for term in {t for w in set(map(bare, set(text.split()))) if len(w) > 1 for t in stems(w)}:
                    held[term, fold][toxic > 0] += 1
            if len(held) > 500_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    counted = rows.select("text", "fold", "toxic").mapInArrow(run, "term string, fold int, other long, toxic long")
    sums = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("other", "toxic") for k in range(1, FOLDS)]
    found = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *sums).where(F.col("toxic") >= LEAST_DOCS)
    all_other, all_toxic = (sum(t[i] for t in totals.values()) for i in (0, 1))
    telling = _log_odds(F.col("toxic"), F.col("other"), all_toxic, all_other) > LEAST_ODDS - 1e-6
    for k in range(1, FOLDS):
        other, toxic = totals.get(k, (0, 0))
        telling |= _log_odds(F.col("toxic") - F.col(f"toxic{k}"), F.col("other") - F.col(f"other{k}"), all_toxic - toxic, all_other - other) > LEAST_ODDS - 1e-6
    return found.where(telling).collect()


def lexicon(counts: list, totals: dict[int, tuple[int, int]], without: int = 0) -> frozenset[str]:
    """Terms whose log-odds of toxic are high, counted without one fold."""
    folds = [k for k in range(1, FOLDS) if k != without]
    all_other, all_toxic = (sum(totals.get(k, (0, 0))[i] for k in folds) for i in (0, 1))
    out = set()
    for row in counts:
        toxic, other = sum(row[f"toxic{k}"] for k in folds), sum(row[f"other{k}"] for k in folds)
        odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((other + 0.5) / (all_other + 1))
        if toxic >= LEAST_DOCS - bool(without) and odds >= LEAST_ODDS:
            out.add(row["term"])
    return frozenset(out)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled training rows."""
    rows = labelled(docs, labels, sample)
    totals = {r["fold"]: (r["other"], r["toxic"]) for r in rows.groupBy("fold").agg(F.count_if(F.col("toxic") <= 0).alias("other"), F.count_if(F.col("toxic") > 0).alias("toxic")).collect()}
    other, toxic = (sum(t[i] for t in totals.values()) for i in (0, 1))
    if not other or not toxic:
        return Model(toxic / max(1, toxic + other))
    counts = term_counts(rows, totals)
    lexicons = {k: lexicon(counts, totals, k) for k in range(FOLDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {k: Codes(x) for k, x in lexicons.items()}
        for batch in batches:
            found = [features(t, codes[k]) for t, k in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "fold", "toxic", "x"])

    got = rows.select("doc_id", "fold", "toxic", "text").mapInArrow(run, "doc_id long, fold int, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y, fold = np.array([r["x"] for r in got]), np.array([r["toxic"] > 0 for r in got], float), np.array([r["fold"] for r in got])
    raw = np.zeros(len(y))
    for k in np.unique(fold):
        train = fold != k
        raw[~train] = fit_trees(x[train], y[train]).raw(x[~train]) if 0 < y[train].sum() < train.sum() else 0.0
    knots, values = fit_isotonic(raw, y)
    return Model(float(y.mean()), lexicons[0], fit_trees(x, y), knots, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.lexicon)
        for batch in batches:
            x = np.array([features(t, codes) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            got = np.clip(model.calibrated(x), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype("int32"), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 0).alias("held_out"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def not_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose predicted label is 0, all columns unchanged, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            x = np.array([features(t, codes) for t in texts]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.calibrated(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)
