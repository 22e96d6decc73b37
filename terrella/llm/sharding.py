"""Sharding along a Hilbert curve over quantised metadata, so that each shard's files span few values of every dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_size, fresh, written

BITS = 4
SHARDS = 16
#: Rows that one part of a curve cell should hold; a cell of more rows is split by more bits of the row key.
PART_ROWS = 200_000


def hilbert_position(point: list[int], bits: int) -> int:
    """Place of a grid point on the Hilbert curve: undo the turns from the highest bit down, Gray-code, interleave."""
    x, d = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for axis in range(d):
            if x[axis] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[axis]) & low
                x[0] ^= swap
                x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flips = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            flips ^= (1 << b) - 1
    x = [v ^ flips for v in x]
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place * 2 + (v >> b & 1)
    return place


def table(values: list[int], kind: str) -> Column:
    """A constant array, folded by the optimizer, quick to build also for thousands of entries."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of `bits`-bit coordinates (null: 0), looked up in the table of all cells."""
    d = len(cells)
    places = [hilbert_position([n >> bits * (d - 1 - i) & (1 << bits) - 1 for i in range(d)], bits) for n in range(1 << bits * d)]
    at = F.lit(0)
    for c in cells:
        at = at * (1 << bits) + F.coalesce(c.cast("int"), F.lit(0))
    return F.element_at(table(places, "long"), at + 1)


def categorical(docs: DataFrame, c: Column, bits: int = BITS) -> Column:
    """Cell of a category: the commonest have one each, the others share the rest by hash; null has cell 0.

    All rows are counted; the driver gets the 2^bits - 4 commonest (ties to the smaller name).
    """
    cells = 1 << bits
    name = c.cast("string")
    own = cells - 4 if bits > 2 else 0
    top = docs.where(name.isNotNull()).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "name").limit(own).select("name").collect()
    place = F.array_position(F.array(*[F.lit(r[0]) for r in sorted(top)]).cast("array<string>"), name)
    shared = F.pmod(F.xxhash64(name), F.lit(cells - 1 - own)) + 1 + own
    return F.when(name.isNull(), F.lit(0)).when(place > 0, place).otherwise(shared).cast("int")


def magnitude(docs: DataFrame, c: Column, bits: int = BITS) -> Column:
    """Cell of a size, by its rank: eighths of octaves are counted over all rows and cut into runs of like many rows.

    Null, and what is not positive, counts as 1. The driver gets the counts, at most 512 of them.
    """
    step = F.least(F.floor(F.log2(F.greatest(F.coalesce(c.cast("double"), F.lit(1.0)), F.lit(1.0))) * 8), F.lit(511)).cast("int")
    counts = sorted(docs.groupBy(step.alias("step")).count().collect())
    rows, seen, cells = sum(n for _, n in counts), 0, [0] * 512
    for at, n in counts:
        cells[at] = min((1 << bits) - 1, ((2 * seen + n) << bits) // (2 * rows))
        seen += n
    return F.element_at(table(cells, "int"), step + 1)


def hilbert_shards(docs: DataFrame, cells: list[Column], row_key: list[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """docs with curve (long), shard (int) and slot (long, gapless from 0 within a shard).

    Rows in the order of (curve index, hash of row_key, row_key) are cut into runs whose counts differ by at most one.
    A first pass counts rows by curve cell; there are at most 2^(bits * dimensions) cells (4096 here), so their running
    sum is taken on the driver. Large cells are split into parts by the leading bits of the hash, with the rows of lower
    parts counted, and a row's rank is the rows of lower cells and parts plus its place within its part. Parts decide
    about tasks, never about the order: a cell with a third of all rows is many tasks. Rows with equal keys are
    interchangeable. Null coordinates are 0. Extra columns stay; clashing names get leading underscores. An empty table
    gives no rows.
    """
    n_curve, n_shard, n_slot, n_hash, n_part, n_c, n_p, n_start, n_rank = fresh(docs, "curve", "shard", "slot", "_hash", "_part", "_c", "_p", "_start", "_rank")
    curve = hilbert_index(cells, bits)
    counts = dict(docs.groupBy(curve.alias("c")).agg(F.count(F.lit(1))).collect())
    rows, below, split = 0, [], []
    for c in range(1 << (bits * len(cells))):
        below.append(rows)
        split.append((counts.get(c, 0) * 2 // PART_ROWS).bit_length())
        rows += counts.get(c, 0)
    of_cell = lambda values, kind: F.element_at(table(values, kind), F.col(n_curve).cast("int") + 1)
    unsigned = F.col(n_hash).bitwiseXOR(F.lit(-(1 << 63)))
    placed = docs.withColumn(n_curve, curve).withColumn(n_hash, F.xxhash64(*row_key))
    placed = placed.withColumn(n_part, F.when(of_cell(split, "int") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", unsigned, 64 - of_cell(split, "int"))))
    parts = placed.groupBy(F.col(n_curve).alias(n_c), F.col(n_part).alias(n_p)).agg(F.count(F.lit(1)).alias(n_rank))
    parts = parts.withColumn(n_start, F.sum(n_rank).over(Window.partitionBy(n_c).orderBy(n_p)) - F.col(n_rank)).drop(n_rank)
    joined = placed.join(parts, (F.col(n_curve) == F.col(n_c)) & (F.col(n_part) == F.col(n_p)))
    order = Window.partitionBy(n_curve, n_part).orderBy(n_hash, *row_key)
    ranked = joined.withColumn(n_rank, of_cell(below, "long") + F.col(n_start) + F.row_number().over(order) - 1)
    ranked = ranked.withColumn(n_shard, F.expr(f"cast(`{n_rank}` * {shards}L div {max(rows, 1)}L as int)"))
    slot = F.expr(f"`{n_rank}` - (cast(`{n_shard}` as long) * {rows}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn(n_slot, slot).select(*docs.columns, n_curve, n_shard, n_slot)


def metadata_cells(docs: DataFrame, size: Column, source: Column, lang: Column) -> list[Column]:
    """Cells of docs' rows by size, source and language, from counts of all of them."""
    return [magnitude(docs, size), categorical(docs, source), categorical(docs, lang)]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    slim = written(docs.select("doc_id", "lang", "source", (byte_size(F.col("text")) + 1).alias("size"), F.crc32(text).alias("text_crc32")), "slim")
    cells = metadata_cells(slim, F.col("size"), F.col("source"), F.col("lang"))
    out = hilbert_shards(slim, cells, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
