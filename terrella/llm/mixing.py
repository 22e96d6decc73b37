"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN, fresh

SEED = "mix-1"
EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hex digits of the sampling key that split a source into parts, so that a hot source is many tasks.
PART_DIGITS = 3


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Targets of rows (source, source_size, weight); source may be null.

    Clamping sources at epochs times their size and resharing the excess by weight until none is above ends at
    target = min(cap, level * weight). The sources that the rounds clamp are a prefix by cap / weight, so the level is
    found in one sweep over sources (never over documents) in that order: the first source whose cap exceeds what its
    weight would get when all before it are clamped sets the level. Where all sizes are 0, targets are 0.
    """
    cap = F.col("source_size") * epochs
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = sources.select(
        "*",
        cap.alias("cap"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("clamped"),
        F.sum("weight").over(after).alias("open_weight"),
    ).withColumn("level", (F.col("all_size") - F.col("clamped")) / F.col("open_weight"))
    whole_order = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(whole_order)
    return swept.withColumn("level", first).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def source_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: the weights in turn over sources in code point order, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", epochs: int = EPOCHS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (0 to epochs): how often the mix takes each row.

    All rows of a source are taken floor(target / source_size) times, and a seeded choice of them once more: in the
    order of md5(seed, doc_id), a row is taken while the middle of its words lies below the words still wanted, so what
    a source gives differs from its target by at most half a document. The running sums are by (source, first digits of
    the md5), with the sums of whole parts before; no source is one task. The order does not depend on the parts.

    Null texts have size 0 and, like all rows of size 0, get only whole repetitions. Null sources are a source of their
    own. Null doc_ids share one key; their rows come behind the part that holds it, in the order of size and tie, and
    are parts of their own by both. Rows with equal ids go by size, then tie (a hash of the text, unless one is given),
    so reruns agree; rows equal in all of it are interchangeable, and how many of them are taken is determined. Long
    texts are read once, for their size. Extra columns stay; the added names get leading underscores if docs has them
    already. An empty table gives no rows.
    """
    n_size, n_total, n_target, n_copies, n_key, n_tie, n_part, n_s, n_p, n_before = fresh(docs, "size", "source_size", "target", "copies", "_key", "_tie", "_part", "_s", "_p", "_before")
    id_ = F.col(doc_id).cast("string")
    keyed = docs.withColumn(n_size, size if size is not None else token_count(F.col(text)))
    keyed = keyed.withColumn(n_key, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_, F.lit("")))))
    keyed = keyed.withColumn(n_tie, F.lpad(F.hex(tie if tie is not None else F.xxhash64(text)), 16, "0"))
    without_id = F.concat(F.lit(":"), F.lpad(F.col(n_size).cast("string"), 19, "0"), F.substring(n_tie, 1, 2))
    keyed = keyed.withColumn(n_part, F.concat(F.substring(n_key, 1, PART_DIGITS), F.when(id_.isNull(), without_id).otherwise("")))
    parts = keyed.groupBy(F.col(source).alias("source"), F.col(n_part).alias("part")).agg(F.sum(n_size).alias("part_size"))
    sources = water_fill(source_weights(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights), epochs)
    in_order = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("part_before", F.sum("part_size").over(in_order) - F.col("part_size"))
    plan = parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias(n_s), F.col("p.part").alias(n_p), F.col("part_before").alias(n_before), F.col("source_size").alias(n_total), F.col("target").alias(n_target)
    )
    running = Window.partitionBy(source, n_part).orderBy(n_key, n_size, F.col(doc_id), n_tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(plan, F.col(source).eqNullSafe(F.col(n_s)) & (F.col(n_part) == F.col(n_p)))
    joined = joined.withColumn(n_before, F.col(n_before) + F.sum(n_size).over(running) - F.col(n_size))
    whole = F.when(F.col(n_total) > 0, F.floor(F.col(n_target) / F.col(n_total))).otherwise(F.lit(0)).cast("long")
    left = F.col(n_target) - whole * F.col(n_total)
    extra = (F.col(n_size) > 0) & (F.lit(2.0) * F.col(n_before) + F.col(n_size) <= F.lit(2.0) * left)
    return joined.select(*docs.columns, n_size, n_total, n_target, (whole + F.when(extra, 1).otherwise(0)).cast("long").alias(n_copies))


def repeated(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Each row as often as the mix takes it."""
    (turn,) = fresh(mixed, "turn")
    return mixed.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", token_count(F.col("text")).alias("n_words"), F.xxhash64("text").alias("digest"))
    mixed = mix(sized, size=F.col("n_words"), tie=F.col("digest"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM totals),
swept AS (
  SELECT *, sum(source_size) OVER () AS all_size,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighted),
levels AS (SELECT *, (all_size - clamped)::DOUBLE / open_weight AS level FROM swept),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, (first_value(CASE WHEN cap >= level * weight THEN level END IGNORE NULLS)
           OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND 2.0::DOUBLE * before + size <= 2.0::DOUBLE * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
