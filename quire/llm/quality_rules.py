"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every measure is an integer column built from SQL functions; a rule compares ``scale * measure``
with ``percent * base``, so no float enters a verdict. There is no shuffle: the plan is a scan and
projections, whatever the size of the table.

Repeated passages are found without comparing windows to each other: words become 64-bit hashes,
three pairwise hashes (strides 1, 2 and 4) make the hash of each window of eight words, and only a
text in which two windows agree has its windows sorted.

Defined results: a null text has no words (all measures 0, ``base_failed`` true); very long texts are
measured whole, and no rule fails a text for being long; an empty table gives an empty result; rows are
judged one by one, so repeated rows give equal results and there are no ties; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import SPACE_CLASS, WORD_CLASS, text_or_empty

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the languages at hand, all lower case.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was are this by an or from at not which "
    "der die das und ist nicht ein eine zu den mit von für auf im dem sie er des auch es "
    "le la les de et un une est que pour dans qui il elle du en sur avec par au ce "
    "el los las y del que no se por una su con para como más o pero sus a"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``scale * measure`` is above (or below) ``percent * base``."""

    name: str
    measure: str
    fails: str
    percent: int
    base: str | None = None
    scale: int = 100

    def column(self) -> Column:
        left = F.col(self.measure) * self.scale
        right = F.lit(self.percent) * (F.col(self.base) if self.base else F.lit(1))
        return left > right if self.fails == "above" else left < right

    def sql(self) -> str:
        right = f"{self.percent} * {self.base or 1}"
        return f"{self.measure} * {self.scale} {'>' if self.fails == 'above' else '<'} {right}"


#: These two make up base_failed.
BASE_RULES = (
    Rule("too_few_words", "n_words", "below", 20, scale=1),
    Rule("repeated_passages", "n_repeat_words", "above", 30, "n_words"),
)

#: A text that passes the base rules is kept if it passes these too.
RULES = (
    Rule("short_words", "word_chars", "below", 250, "n_words"),
    Rule("long_words", "word_chars", "above", 1500, "n_words"),
    Rule("symbols", "n_symbols", "above", 20, "n_words"),
    Rule("stop_words", "n_stop_words", "below", 3, "n_words"),
    Rule("repeated_lines", "n_dup_lines", "above", 40, "n_lines"),
    Rule("capitals", "n_capitals", "above", 50, "word_chars"),
    Rule("exclamations", "n_exclaim", "above", 40, "n_words"),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the integer measures of each whole text."""
    base = docs.select("doc_id", text_or_empty(text).alias("_text"))
    split = base.select(
        "doc_id",
        "_text",
        F.array_remove(F.split("_text", f"{SPACE_CLASS}+"), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD_CLASS)).alias("_lines"),
    )
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    counted = split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - count(SPACE_CLASS)).alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_capitals"),
        count("!").alias("n_exclaim"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_hash"),
    )
    for stride in (1, 2, 4):
        paired = F.zip_with("_hash", F.slice("_hash", stride + 1, F.size("_hash")), lambda a, b: F.xxhash64(a, b))
        counted = counted.withColumn("_hash", paired)
    windows = counted.withColumn("_hash", F.slice("_hash", 1, (F.col("n_words") - (WINDOW - 1)).cast("int")))
    some = F.size(F.array_distinct("_hash")) < F.size("_hash")
    at = F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    sorted_ = windows.withColumn("_sorted", F.when(some, F.sort_array(at))).drop("_hash")
    twice = F.filter(
        F.transform(
            "_sorted",
            lambda s, i: F.when(
                F.coalesce(s["h"] == F.get("_sorted", i - 1)["h"], F.lit(False))
                | F.coalesce(s["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)),
                s["i"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    starts = sorted_.withColumn("_at", F.sort_array(twice)).drop("_sorted")
    lengths = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    return starts.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_at")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row per document: the measures, ``base_failed``, ``kept`` and the names of failed rules."""
    measured = measures(docs, text)
    failed = lambda which: reduce(lambda a, b: a | b, [r.column() for r in which], F.lit(False))
    names = F.array_compact(F.array(*[F.when(r.column(), F.lit(r.name)) for r in (*BASE_RULES, *rules)]))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select(
        "doc_id",
        *shown,
        failed(BASE_RULES).alias("base_failed"),
        (~failed((*BASE_RULES, *rules))).alias("kept"),
        F.array_join(names, ",").alias("failed_rules"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    any_of = lambda which: " OR ".join(f"({r.sql()})" for r in which)
    space = r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rule_names = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in (*BASE_RULES, *RULES))
    return f"""
    WITH base AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
    ), words AS (
      SELECT rid, doc_id, t,
        list_filter(regexp_split_to_array(t, '{space}+'), lambda w: w <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM base
    ), win AS (
      SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words WHERE len(ws) > {WINDOW})
    ), dup AS (
      SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1
    ), rep AS (
      SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
    ), m AS (
      SELECT doc_id, len(ws)::BIGINT AS n_words,
        (length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
        len(list_filter(ws, lambda w: lower(w) IN ({stop})))::BIGINT AS n_stop_words,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM words LEFT JOIN rep USING (rid)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      ({any_of(BASE_RULES)}) AS base_failed,
      NOT ({any_of((*BASE_RULES, *RULES))}) AS kept,
      array_to_string(list_filter([{rule_names}], lambda x: x IS NOT NULL), ',') AS failed_rules
    FROM m"""
