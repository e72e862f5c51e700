"""Quality rules against a direct count."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.quality_rules import quality_rules
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(spark, rows, extra):
    got = quality_rules(cases.table(spark, rows, extra)).collect()
    want = sorted(brute(r[1]) for r in rows)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_awkward_rows(spark):
    check(spark, cases.ROWS, True)


def test_empty_table(spark):
    assert quality_rules(cases.empty(spark)).count() == 0


def test_no_python_in_plan(spark):
    plan = quality_rules(cases.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "\n", "#x"]), max_size=60), min_size=1, max_size=30))
def test_repeats(spark, texts):
    check(spark, [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], False)
