"""Rollups: signed deltas, replays, compaction, and ledgers."""

import random
from collections import Counter

from quire.llm import token_rollup as tr
from quire.llm.token_rollup import Rollup, changes_between, corpus_totals
from tests.llm import cases

LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long"


def shown(df):
    return sorted(((r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens) for r in df.collect()), key=str)


def expected(ledger):
    docs, tokens = Counter(), Counter()
    for _, s, lang, t, n in ledger:
        docs[s, lang, t] += 1
        tokens[s, lang, t] += n or 0
    return sorted(((*k, docs[k], tokens[k]) for k in docs), key=str)


def test_random_life(spark, tmp_path):
    rng, rollup, old = random.Random(5), Rollup(spark, str(tmp_path)), []
    for step in range(4):
        new = [(i, rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t1", "t2"]), rng.choice([None, 0, 5, 9])) for i in range(40) if rng.random() < 0.7]
        feed = changes_between(spark.createDataFrame(old, LEDGER), spark.createDataFrame(new, LEDGER))
        assert rollup.commit(f"b{step}", feed)
        assert not rollup.commit(f"b{step}", feed)
        if step == 2:
            rollup.compact()
            assert not rollup.commit("b0", feed)
        assert shown(rollup.totals()) == expected(new)
        old = new
    rollup.compact()
    assert shown(rollup.totals()) == expected(old) and rollup.committed() == {"b0", "b1", "b2", "b3"}


def test_commit_inside_compact(spark, tmp_path):
    """A batch that commits while a base is made counts once, before and after the next compaction."""
    rollup, other = Rollup(spark, str(tmp_path)), Rollup(spark, str(tmp_path))
    one = lambda i: changes_between(spark.createDataFrame([], LEDGER), spark.createDataFrame([(i, "a", "en", "t1", 5)], LEDGER))
    rollup.commit("b1", one(1))
    totals = rollup.totals

    def late(*args):
        found = totals(*args)
        assert other.commit("b2", one(2))
        return found

    rollup.totals = late
    rollup.compact()
    for _ in range(2):
        assert shown(other.totals()) == [("a", "en", "t1", 2, 10)] and other.committed() == {"b1", "b2"}
        assert not other.commit("b2", one(2))
        other.compact()


def test_half_written_batch_does_not_count(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path))
    tr.signed(tr.inserts(cases.table(spark))).write.parquet(f"{tmp_path}/data/x-1")
    (tmp_path / "batch").mkdir()
    (tmp_path / "batch" / "x").touch()
    assert rollup.committed() == set() and rollup.totals().count() == 0
    assert rollup.commit("x", tr.inserts(cases.table(spark))) and rollup.committed() == {"x"}


def test_awkward_rows(spark):
    want = [(d, s, lang, "words/1", len((t or "").split())) for d, t, lang, s, _ in cases.ROWS]
    got = [r for r in shown(corpus_totals(cases.table(spark))) if r[2] == "words/1"]
    assert got == expected(want)


def test_empty_table(spark):
    assert corpus_totals(cases.empty(spark)).count() == 0


def test_all_documents_and_bpe(spark):
    import public_tokenizers

    from quire.llm import byte_bpe

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = byte_bpe.encoder(ranks, public_tokenizers.PATTERN)
    want = [(d, s, lang, name, n) for d, t, lang, s, _ in cases.ROWS for name, n in (("words/1", len((t or "").split())), ("codepoints/1", len(t or "")), ("bpe", len(byte_bpe.encode_text(t or "", encoding))))]
    got = [r for r in shown(tr.all_totals(cases.table(spark), "bpe", ranks, public_tokenizers.PATTERN)) if r[2] != "letter-runs/2"]
    assert got == expected(want)
    assert tr.all_totals(cases.empty(spark), "bpe", ranks, public_tokenizers.PATTERN).count() == 0
