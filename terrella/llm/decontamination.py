"""Benchmark decontamination by a prefix-filtered set join of benchmark windows against whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .common import BROADCAST_BYTES, discard, fresh, rows_of, small, words, written

WINDOW = 13
SHINGLE = 5
#: A document is contaminated if at least this share of its words is hit, as a numerator of 20.
SHARE_OF_20 = 1


def shingle_key(array: str, at: Column, width: Column | int, widths: list[int]) -> Column:
    """Hash of the `width` words of an array from position `at` (from 0) on."""
    keys = {k: F.xxhash64(F.lit(k), *[F.get(F.col(array), at + i) for i in range(k)]) for k in widths}
    if isinstance(width, int):
        return keys[width]
    out = F.lit(None).cast("long")
    for k, key in keys.items():
        out = F.when(width == k, key).otherwise(out)
    return out


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Rows (item, w, n, k, window) of the items' windows: the id as a string, words, their number, shingle width, sha256.

    An item of fewer words than a window is one window; without words, or with a null id, it has none.
    """
    split = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("all")).where(F.size("all") > 0)
    n = F.least(F.lit(window), F.size("all"))
    spans = split.select("item", "all", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("all") - n)).alias("at"))
    spans = spans.select("item", "n", F.slice("all", F.col("at") + 1, F.col("n")).alias("w")).withColumn("window", window_key(F.col("w")))
    return spans.distinct().withColumn("k", F.least(F.lit(shingle), F.col("n")))


def window_key(w: Column) -> Column:
    """What stands for a run of words; words hold no blank, so different runs differ here but for a collision of SHA-256."""
    return F.sha2(F.concat_ws(" ", w), 256)


def positions(docs: DataFrame, text: Column, keep: list[Column], widths: list[int]) -> DataFrame:
    """For each document a row at -1 and one at each word position, by shingle width: keep, n_words, at, k, key.

    key is null where the shingle would pass the end, and at -1, which stands for the document itself. Rows are narrow:
    the words are not among them.
    """
    split = docs.select(*keep, words(text).alias("words"))
    at = split.select("*", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("_place", "_word"))
    at = at.withColumn("at", F.col("_place") - 1).drop("_place", "_word")
    at = at.withColumn("k", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0]))
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("k") <= F.size("words"))
    key = F.when(inside, shingle_key("words", F.col("at"), F.col("k") if len(widths) > 1 else widths[0], widths))
    return at.withColumn("key", key).withColumn("n_words", F.size("words")).drop("words")


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: the id, digest (xxhash64 of the text), n_words, n_hit, n_items (long) and items (sorted array).

    Containment of a whole window in a document makes one shingle of it a sufficient prefix: the rarest by its count
    over all documents. One pass over the documents looks up the shingle of each word position among the benchmark's and
    writes the places found, which are few; counts of them order each window's shingles, and windows with a shingle that
    occurs nowhere are out. Places that hold a prefix shingle are candidates: the shingle's offset in the window, the
    window's length and the document's length bound where the window would stand (positional and length filter). The
    documents that have candidates are read once more and the words there are compared. The benchmark's shingles, 16 bytes
    each, are broadcast if they are counted small; else the pass joins narrow rows (id, digest, place, key) with them.
    No exchange carries a document's words, and its text only if it has candidates. What is gathered by text is bounded by
    its own words; items come by a join with the windows that were found.

    Null texts, and texts without words, have no words and no hits; long texts are read whole. Repeated rows each give a
    row; a null id is an id. Empty tables: no documents give no rows, no benchmark gives no hits. Other columns are not
    looked at, so their names do not matter.
    """
    col = F.col
    spans = written(benchmark_windows(benchmark, item_id, item_text, window, shingle), "windows")
    widths = sorted(r[0] for r in spans.select("k").distinct().collect()) or [shingle]
    offsets = spans.select("window", "w", "n", "k").distinct().withColumn("off", F.explode(F.sequence(F.lit(0), col("n") - col("k"))))
    offsets = written(offsets.select("window", "n", "off", shingle_key("w", col("off"), col("k"), widths).alias("key")), "offsets")
    keys = written(offsets.select(col("key").alias("own")).distinct(), "shingles")

    slim = docs.select(col(doc_id).alias("id"), F.xxhash64(col(text)).alias("digest"), col(text).alias("text"))
    at = positions(slim, col("text"), [col("id"), col("digest")], widths)
    document = (col("at") < 0) & (col("k") == widths[0])
    if rows_of(keys) * 16 <= broadcast_bytes:
        seen = at.join(F.broadcast(keys), col("key") == col("own"), "left").where(col("own").isNotNull() | document)
    else:
        whole = slim.select("id", "digest", F.lit(-1).alias("at"), F.lit(widths[0]).alias("k"), F.lit(None).cast("long").alias("key"), F.size(words(col("text"))).alias("n_words"), F.lit(None).cast("long").alias("own"))
        seen = at.where("key is not null").join(keys, col("key") == col("own")).select(*whole.columns).union(whole)
    seen = written(seen.select("id", "digest", "n_words", "at", "key"), "places")

    places = seen.where("at >= 0")
    counts = places.groupBy(col("key").alias("own")).agg(F.count(F.lit(1)).alias("df"))
    rarest = F.min_by(F.struct("off", "key", "df"), F.struct(F.coalesce("df", F.lit(0)), "off"))
    prefix = offsets.join(counts, col("key") == col("own"), "left").groupBy("window", "n").agg(rarest.alias("p")).where(col("p.df") > 0)
    prefix = prefix.select("window", "n", "p.off", col("p.key").alias("own"))
    start = col("at") - col("off")
    # From here on equal digests stand for equal texts, so copies are looked at once.
    found = places.join(prefix, col("key") == col("own")).where((start >= 0) & (start + col("n") <= col("n_words")))
    found = found.groupBy("digest").agg(F.collect_set(F.struct(start.alias("s"), "n", "window")).alias("spans"))
    found = written(found.select(col("digest").alias("own"), "spans"), "candidates")
    texts = slim.join(small(found, 16).select("own"), col("digest") == col("own"), "left_semi").select("digest", "text").dropDuplicates(["digest"])
    both = found.join(texts, col("own") == col("digest"))
    # A text is cut into words once, not for each of its spans.
    standing = let(words(col("text")), lambda w: F.filter("spans", lambda x: window_key(F.slice(w, x["s"] + 1, x["n"])) == x["window"]))
    held = written(both.select("digest", F.array_sort(standing).alias("spans")).where(F.size("spans") > 0), "held")
    items = held.select("digest", F.explode(F.array_distinct(F.transform("spans", lambda x: x["window"]))).alias("window")).join(spans.select("window", "item").distinct(), "window")
    items = items.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["e"], x["s"] + x["n"]).alias("e"), (acc["n"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(x["s"], acc["e"]))).alias("n")),
    )["n"]
    marked = held.join(items, "digest").select(col("digest").alias("own"), covered.cast("long").alias("hit"), "items", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e"))).alias("spans"))
    whole = seen.where("at < 0").join(marked, col("digest") == col("own"), "left")
    none = F.array().cast("array<string>")
    out = whole.select(
        col("id").alias(doc_id),
        "digest",
        col("n_words").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    )
    discard(offsets, keys, found)
    return out


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words") * SHARE_OF_20)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows of which at least a twentieth of the words is hit; all their columns, extra ones too.

    Rows with null texts stay. The join is by id and text digest, null-safe, so rows that share an id are kept apart.
    """
    n_digest, n_id = fresh(docs, "_digest", "_id")
    bad = written(hits(docs, benchmark, doc_id, text, **options).where(contaminated()).select(F.col(doc_id).alias(n_id), F.col("digest").alias(n_digest)).distinct(), "contaminated")
    same = docs[doc_id].eqNullSafe(bad[n_id]) & (F.xxhash64(docs[text]) == bad[n_digest])
    return docs.join(small(bad, 64), same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS s FROM doc, lens)),
hit AS (SELECT r, s, spot.n, item FROM spot JOIN win ON spot.t = win.t AND spot.n = win.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
