"""Toxicity: held-out accuracy, folds, and awkward input."""

import math
import re
import zlib

import numpy as np
import pytest

from quire.llm import toxicity
from quire.llm.boosting import fit_isotonic, fit_trees
from quire.llm.toxicity import fit, not_toxic, score
from tests.llm import cases

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    return docs, labels, fit(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, model = trained
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(got) == docs.count()
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for _, g in held)
    right = np.mean([t == g.predicted for t, g in held])
    order = [(a.score > b.score) + 0.5 * (a.score == b.score) for x, a in held for y, b in held if x and not y]
    assert right >= 0.9 and np.mean(order) >= 0.85


def test_filter_agrees_with_scores(trained):
    docs, _, model = trained
    kept = {r.doc_id for r in not_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in score(docs, model).collect() if not r.predicted}
    assert not_toxic(docs, model).columns == docs.columns


def test_same_again(trained):
    docs, labels, model = trained
    again = fit(docs.repartition(7), labels.repartition(3))
    assert again.lexicon == model.lexicon and np.allclose(again.values, model.values)


def test_awkward_rows(spark, trained):
    docs = cases.table(spark)
    got = score(docs, trained[2]).collect()
    assert len(got) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got} == {0}
    assert not_toxic(docs, trained[2]).columns == docs.columns
    assert score(cases.empty(spark), trained[2]).count() == 0


def test_labels_missing(spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit(cases.table(spark), labels)
    assert {r.score for r in score(cases.table(spark), model).collect()} == {0.0}
    one = fit(cases.table(spark), spark.createDataFrame([(1, 1, 1), (2, 1, 1), (6, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int"))
    assert one.share == 1.0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    knots, values = fit_isotonic(s, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()
    assert abs(np.interp(s, knots, values).mean() - y.mean()) < 0.02


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((fit_trees(x, y).raw(x) > 0) == y).mean() > 0.97


def plain_features(text, lexicon):
    """The features by loops over words."""
    words = (text or "").split()
    if not words:
        return [0.0] * toxicity.N_FEATURES
    found = {"word": 0, "stem": 0, "seed": 0, "disguised": 0, "shout": 0, "obfuscated": 0}
    hits, you = [], []
    for i, raw in enumerate(words):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", raw.lower())
        stems = [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]
        kinds = {"word": word in lexicon, "stem": any(x in lexicon for x in stems), "seed": word in toxicity.SEED_WORDS, "shout": len(word) > 1 and raw.isupper()}
        kinds["obfuscated"] = bool(re.search(r"[^\W\d_][*@$!|#0134579._-]+[^\W\d_]", raw))
        spelt = word
        for a, b in zip("013457@$!|", "oieastasil", strict=True):
            spelt = spelt.replace(a, b)
        spelt = {re.sub(r"[\W_]", "", spelt), re.sub(r"[\W\d_]", "", word)}
        kinds["disguised"] = kinds["obfuscated"] and any(w in toxicity.SEED_WORDS or w in lexicon for w in spelt)
        for kind, is_so in kinds.items():
            found[kind] += is_so
        if kinds["word"] or kinds["stem"] or kinds["seed"] or kinds["disguised"]:
            hits.append(i)
        if word in toxicity.SECOND_PERSON:
            you.append(i)
    n, near = len(words), sum(any(abs(i - k) <= toxicity.NEAR for k in you) for i in hits)
    upper, lower = (len(re.findall(x, text)) for x in ("[A-Z]", "[a-z]"))
    marks = text.count("!") + text.count("?")
    rates = [found[k] / n for k in ("word", "stem", "seed", "disguised")]
    return [*rates, float(np.log1p(len(hits))), len(hits) / n, found["word"], found["seed"], near / n, near / max(1, len(hits)), upper / max(1, upper + lower), found["shout"] / n, marks / n, found["obfuscated"] / n, float(np.log1p(n))]


def plain_score(text, model):
    """The score by walking each tree and a line between two knots."""
    x = plain_features(text, model.lexicon)
    raw = model.trees.base
    for features, thresholds, values in zip(model.trees.features, model.trees.thresholds, model.trees.values, strict=True):
        node = 0
        for _ in range(model.trees.depth):
            node = 2 * node + (2 if x[features[node]] > thresholds[node] else 1)
        raw += values[node - len(features)]
    knots, at = model.knots, 0
    while at < len(knots) and knots[at] < raw:
        at += 1
    if at in (0, len(knots)):
        level = model.values[min(at, len(knots) - 1)]
    else:
        (x0, x1), (y0, y1) = knots[at - 1 : at + 1], model.values[at - 1 : at + 1]
        level = y0 + (y1 - y0) * (raw - x0) / (x1 - x0)
    return 0.999 * level + 0.001 / (1 + math.exp(-max(-30, min(30, raw))))


def test_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    want = {r.doc_id: plain_score(r.text, model) for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert set(got) == set(want) and all(abs(got[d].score - w) < 1e-9 for d, w in want.items())
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
