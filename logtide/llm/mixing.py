"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, the source's target over
its size. Documents stand in line within their source; a document's prefix sum is its place
times that expectation. One random offset per source is added, and the document is taken once
for every integer between the sum before it and the sum after it.

The line is ordered by size class first, so each stretch of a hundred places holds documents
of like size and the words taken come close to the target. Places come from counts of small
blocks (source, size class, slice of ids) and a row number within the block: no task sees
a whole source.

Nulls and odd rows: a null text has size 0; a null source is a source of its own, after all
others; a null doc_id is kept as it is; repeated rows take separate places; documents of one size stand in order of
doc_id and then of a hash of the row; texts of any length are counted whole; an empty table gives an empty result; a source without words has target 0 and takes nothing. Columns of the
input never clash with the working columns, since the input row travels in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logtide.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, size class, slice) block, about.
BLOCK_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, ceiling: int) -> DataFrame:
    """Water level over (src, words): targets share ``share`` of all words by weight, none above ``ceiling`` times its words.

    In order of words over weight, a source is at its ceiling while the level that would remain
    for it and all later ones reaches that ceiling. The table has a row per source.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("nth", F.row_number().over(Window.orderBy("src")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    before = Window.orderBy("fill", "nth").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("fill", ceiling * F.col("words") / F.col("weight"))
        .withColumn(
            "level",
            (F.lit(share) * F.sum("words").over(everything) - ceiling * F.coalesce(F.sum("words").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        )
        .withColumn("stop", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "nth", "level"))).over(everything))
    )
    full = F.col("stop").isNull() | (F.struct("fill", "nth") < F.struct("stop.fill", "stop.nth"))
    return level.select(
        "src", "words", F.when(full, ceiling * F.col("words").cast("double")).otherwise(F.col("weight") * F.col("stop.level")).alias("target")
    )


def systematic(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    ceiling: int = 2,
    seed: str = "mix",
    carry: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per input row: row (its ``carry`` columns as a struct, by default all), size, source_size, target, copies.

    Words are counted once where ``carry`` names a few columns, whose rows are then stored; else once for the
    blocks and once with the rows, so that no text is written to a table on its way.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    slices = 4 + docs.count() // block_rows
    source = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    lined = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), "doc_id", source.alias("src"), word_count(F.col("text")).alias("size")).select(
        "*",
        F.floor(4 * F.log2(F.col("size") + 1) + 1e-9).cast("long").alias("class"),
        (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slices).alias("slice"),
    )
    block = ["src", "class", "slice"]
    if carry:
        lined = scratch.keep(lined, "sized")
    blocks = scratch.keep(lined.groupBy(*block).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "blocks")
    before = Window.partitionBy("src").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    aims = targets(blocks.groupBy("src").agg(F.sum("words").alias("words")), weights, share, ceiling)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "src")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    place = F.row_number().over(Window.partitionBy(*block).orderBy("size", "doc_id", F.xxhash64("row")))
    expected = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    placed = (
        lined.withColumn("place", place)
        .join(starts, block)
        .join(aims, "src")
        .select("row", "size", F.col("words").alias("source_size"), "target", (F.col("ahead") + F.col("place")).alias("i"), expected.alias("e"), offset.alias("u"))
    )
    crossed = F.floor(F.col("e") * F.col("i") + F.col("u")) - F.floor(F.col("e") * (F.col("i") - 1) + F.col("u"))
    return placed.select("row", "size", "source_size", "target", F.least(crossed, F.ceil("e")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every taken document as often as it is taken, with the columns of ``docs``."""
    taken = systematic(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return systematic(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
lined AS (
  SELECT *, floor(4 * log2(size + 1) + 1e-9)::BIGINT AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (4 + (SELECT count(*) FROM documents) // 1000000) AS slice
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY class, slice, size, doc_id NULLS FIRST) AS i FROM lined),
sources AS (
  SELECT src, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY src) - 1 AS nth FROM sized GROUP BY src),
weighed AS (
  SELECT *, [3, 1, 2][(nth % 3 + 1)::INT] AS weight, 2 * words / [3, 1, 2][(nth % 3 + 1)::INT] AS fill FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(words) OVER ())::DOUBLE
              - 2 * coalesce(sum(words) OVER (ORDER BY fill, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY fill, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed),
stop AS (SELECT fill, nth, level FROM levels WHERE fill > level ORDER BY fill, nth LIMIT 1),
aims AS (
  SELECT l.src, l.words, CASE WHEN s.nth IS NULL OR l.fill < s.fill OR (l.fill = s.fill AND l.nth < s.nth)
                              THEN 2 * l.words::DOUBLE ELSE l.weight * s.level END AS target
  FROM levels l LEFT JOIN stop s ON true),
crossing AS (
  SELECT p.doc_id, p.size, a.words AS source_size, a.target, p.i,
         CASE WHEN a.words > 0 THEN a.target / a.words ELSE 0.0::DOUBLE END AS e,
         ('0x' || substr(md5('mix:' || p.src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN aims a ON p.src = a.src)
SELECT doc_id, size, source_size, target, (least(floor(e * i + u) - floor(e * (i - 1) + u), ceil(e)) * size)::BIGINT AS taken
FROM crossing
"""
