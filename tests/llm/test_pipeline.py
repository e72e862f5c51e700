"""The pipeline against brute-force versions of its stages."""

import hashlib
import os
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quire.llm import toxicity  # noqa: E402
from tests.llm import cases  # noqa: E402
from tests.llm.test_minhash_dedup import brute as near_brute  # noqa: E402
from tests.llm.test_source_mix import brute as mix_brute  # noqa: E402
from tests.llm.test_toxicity import plain_score  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table that each stage was given, and the last result."""
    path = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, DIR).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return [*out, docs]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_go(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    assert rows(stages[1]) == sorted((tuple(r) for r in stages[0].collect() if plain_score(r.text, model) < 0.5), key=str)


def test_copies_go(stages):
    best = {}
    for r in stages[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        if key not in best or (-len(r.text or ""), r.doc_id) < (-len(best[key].text or ""), best[key].doc_id):
            best[key] = r
    assert rows(stages[2]) == sorted(map(tuple, best.values()), key=str)


def test_near_copies_go(stages):
    given = [(r.doc_id, r.text) for r in stages[2].collect()]
    keep = {d for d, _, _, kept in near_brute(given, 80, 5) if kept}
    assert {str(r[0]) for r in rows(stages[3])} == keep and stages[3].count() == len(keep)


def test_mix(stages):
    want = Counter()
    for r in mix_brute([tuple(r) for r in stages[3].select("doc_id", "text", "lang", "source", "n_chars").collect()]):
        d, size, _, _, taken = r
        want[d] += (2 * taken + size) // (2 * size) if size else 0
    assert Counter(r.doc_id for r in stages[4].collect()) == +want
    assert {r[:2] for r in rows(stages[4])} <= {r[:2] for r in rows(stages[3])}


def test_encoding(stages):
    want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in stages[4].collect())
    got = stages[5].collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_run_is_the_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, DIR)) == rows(stages[5])


def test_awkward_and_empty(spark, tmp_path):
    for k, docs in enumerate((cases.table(spark, [*cases.ROWS, (12, "a" + " " * 1_200_000 + "b", "en", "a", 1)]), cases.empty(spark))):
        path = f"{tmp_path}/{k}"
        os.makedirs(path)
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        assert (corpus_pipeline.run(spark, path).count() > 0) == (k == 0)
