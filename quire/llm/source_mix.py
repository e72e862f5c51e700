"""Mixing sources to target weights.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share all words by weight; a
target stops at three times its source's size and the excess goes to the others by weight. Each row
gets a hash-random key; the key space of a source is cut into ranges, range totals give the words
before each range, and a sort inside each range gives the words before each row. The row order of a
source is thus one global random order, and the mix takes it from the start until the source's
budget (its target, rounded) is spent, going round again where the budget exceeds the source. The
row at the cut gives only the words that are left.

No range holds more than about ``RANGE_ROWS`` rows or 1/256 of a source, so a hot source is spread
over as many tasks as any other rows; only doc_id, source, size and key are shuffled.

Defined results: null or wordless texts have size 0 and are never taken; very long texts count whole; a
null source is a source of its own, after the others; ties between equal keys, such as those of rows
with one doc_id or none, are ordered by doc_id and size, and rows that repeat both take their turns in
any order, which changes no result; an empty table gives an empty result; other columns are ignored
by ``mix`` and carried unchanged, whatever their names, by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import text_or_empty, written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_ROWS = 20_000
LEAST_RANGES = 256
SEED = "mix"

#: Bits of a hash-random key.
KEY_BITS = 60


def _weight_sql(rank: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"CASE ({rank} - 1) % {len(WEIGHTS)} {cases} END"


#: From ``sizes(source, source_size)``: a row per source with its target. Sources are capped in the
#: order of size to weight; one is capped if its share of what earlier caps leave exceeds its cap.
TARGETS_SQL = f"""
WITH ranked AS (
  SELECT source, source_size,
    CAST({_weight_sql("row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source)")} AS BIGINT) AS w,
    {MOST_EPOCHS} * source_size AS cap
  FROM sizes
), ordered AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    row_number() OVER (ORDER BY cap / CAST(w AS DOUBLE), w, CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) AS pos
  FROM ranked
), before AS (
  SELECT *, total - CAST(coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    all_w - CAST(coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_w
  FROM ordered
), open AS (
  SELECT *, min(CASE WHEN CAST(cap AS DOUBLE) * rest_w >= CAST(rest AS DOUBLE) * w THEN pos END) OVER () AS first_open FROM before
), final AS (
  SELECT *, max(CASE WHEN pos = first_open THEN rest END) OVER () AS open_rest,
    max(CASE WHEN pos = first_open THEN rest_w END) OVER () AS open_w
  FROM open
)
SELECT source, source_size,
  CASE WHEN pos < first_open OR first_open IS NULL THEN CAST(cap AS DOUBLE)
       ELSE CAST(open_rest * w AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target
FROM final"""


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target, from one row per source."""
    return sizes.sparkSession.sql(TARGETS_SQL.replace("FROM sizes", "FROM {sizes}"), sizes=sizes)


def _key(seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and ``taken`` words."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    ).withColumn("_key", _key(seed))
    rows = written(sized, "mix-sizes").withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    n = rows.count()
    ranges = max(LEAST_RANGES, -(-n // range_rows))
    rows = rows.withColumn("_range", F.shiftright(F.shiftright("_key", KEY_BITS - 30) * ranges, 30))
    totals = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    before = F.sum("_words").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_source", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    per_source = totals.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.first("source").alias("source"))
    goals = targets(per_source.select("source", "source_size")).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    facts = offsets.join(goals.drop("source"), "_source")
    inside = F.sum("size").over(Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(facts, ["_source", "_range"]).withColumn("_at", F.col("_before") + F.coalesce(inside, F.lit(0)))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.expr("_budget div source_size")
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("_at")))
    spent = placed.withColumn("_budget", budget).withColumn("_epochs", F.when(F.col("source_size") > 0, epochs))
    taken = F.coalesce(F.col("_epochs") * F.col("size") + part, F.lit(0)).cast("long")
    return spent.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken, all columns unchanged.

    Whole documents only: the one at a source's cut counts as taken if at least half of its words
    are inside the budget. Rows that repeat a doc_id with different sizes are told apart by size."""
    taken = mix(docs, seed, range_rows).where("taken > 0")
    copies = F.expr("CAST((2 * taken + size) div (2 * size) AS INT)")
    plan = taken.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), copies.alias("_copies")).where("_copies > 0")
    turn = Window.partitionBy("_id", "_size").orderBy("_id")
    plan = plan.withColumn("_turn", F.row_number().over(turn.orderBy(F.desc("_copies"))))
    size = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("doc_id").cast("long").alias("_doc"), size.alias("_n"))
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_doc", "_n").orderBy("_doc")))
    match = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")) & (F.col("_row") == F.col("_turn"))
    taken_rows = rows.join(plan, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return taken_rows.select(*names).toDF(*docs.columns)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {KEY_BITS // 4}))::BIGINT AS k
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), goals AS ({TARGETS_SQL}), p AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS b,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
  FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
       ELSE (b // source_size) * size + greatest(0, least(size, b - (b // source_size) * source_size - at_)) END::BIGINT AS taken
FROM p"""
