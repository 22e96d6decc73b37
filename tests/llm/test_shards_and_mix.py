import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrella.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, curve int, size string"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (i % 7), "en" if i % 3 else "de", "hot" if i % 3 == 0 else f"s{i % 5}", 1, "x") for i in range(90)]
    rows += [(1000, None, None, None, None, None), (1001, "", "en", None, 1, None), (None, "a b", "en", "s1", 1, ""), (5, "word", "en", "s1", 1, "")]
    rows += [(7, "same row", "en", "hot", 1, "")] * 3 + [(2000, "wä " * 30_000, "de", "big", 1, "")]
    return documents(spark, rows)


def test_curve_is_a_walk_through_all_cells():
    for bits, d in ((4, 3), (3, 2), (1, 3), (2, 4)):
        cells = [[n >> bits * (d - 1 - i) & (1 << bits) - 1 for i in range(d)] for n in range(1 << bits * d)]
        way = sorted(cells, key=lambda c: sharding.hilbert_position(c, bits))
        assert sorted(sharding.hilbert_position(c, bits) for c in cells) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(way, way[1:], strict=False))


def shards(df, parts=None):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return sharding.hilbert_shards(df, sharding.metadata_cells(df, size, F.col("source"), F.col("lang")), [F.col("doc_id"), F.xxhash64("text")])


def test_shards_are_even_runs_of_the_curve(docs, monkeypatch):
    once = shards(docs).toPandas()
    assert list(once.columns) == [*docs.columns, "_curve", "shard", "slot"] and len(once) == docs.count()
    count = Counter(once["shard"])
    assert max(count.values()) - min(count.values()) <= 1 and set(count) <= set(range(16))
    for s, own in once.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    order = once.sort_values(["shard", "slot"])["_curve"].tolist()
    assert order == sorted(order)
    monkeypatch.setattr(sharding, "PART_ROWS", 5)  # parts decide about tasks, not about places
    again = shards(docs).toPandas()
    key = ["doc_id", "text", "shard", "slot"]
    assert sorted(map(repr, again[key].values.tolist())) == sorted(map(repr, once[key].values.tolist()))


HELPERS = ["_hash", "_part", "_c", "_p", "_start", "_rank", "_s", "_before", "_target", "_total", "_key", "_tie", "copies", "turn", "slot", "c", "name", "rows", "step", "part", "target"]


def test_names_of_extra_columns_do_not_matter(docs):
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(HELPERS)])
    out = shards(more)
    assert out.columns == [*more.columns, "_curve", "shard", "_slot"] and out.where("c = 15 and _c = 2 and slot = 14").count() == docs.count()
    mixed = mixing.mix(more)
    assert mixed.columns[: len(more.columns)] == more.columns and mixed.where("_s = 6 and copies = 12").count() == docs.count()
    plain = mixing.mix(docs)
    assert mixed.agg(F.sum(mixed.columns[-1])).first() == plain.agg(F.sum("copies")).first()


def test_a_shard_spans_few_cells_of_a_dimension(spark):
    rows = [(i, "w" * (1 << (i * 7919 % 13)), f"l{i % 3}", f"s{i * 31 % 7}", 0, "") for i in range(4_000)]
    out = shards(documents(spark, rows)).select("shard", "source", F.octet_length("text").alias("bytes")).toPandas()
    of = [(len(set(own["source"])), len(set(own["bytes"]))) for _, own in out.groupby("shard")]
    assert sum(a * b for a, b in of) / len(of) <= 0.5 * 7 * 13


def test_cells_follow_counts(spark):
    rows = [(i, "x" * (1 + i), "a", f"s{i % 40}" if i % 2 else "hot", 0, "") for i in range(800)] + [(900, None, None, None, 0, "")]
    df = documents(spark, rows)
    size = F.octet_length("text")
    got = df.select("source", "text", sharding.magnitude(df, size).alias("m"), sharding.categorical(df, F.col("source")).alias("c")).toPandas()
    assert set(got["m"]) <= set(range(16)) and got["m"].nunique() >= 14 and got["m"].value_counts().max() < 130
    assert set(got["c"]) <= set(range(16)) and list(got[got["source"].isna()]["c"]) == [0]
    hot = set(got[got["source"] == "hot"]["c"])
    assert len(hot) == 1 and hot.isdisjoint(got[got["source"] != "hot"]["c"])


def test_shards_of_nothing(docs):
    assert shards(docs.where("doc_id = -5")).collect() == []


def test_shard_digests(spark, tmp_path):
    spark.createDataFrame([(1, "äb", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in sharding.query(spark, str(tmp_path)).collect()}
    assert got == {1: (4, zlib.crc32("äb".encode()), "rows", None), 2: (1, 0, "rows", None)}


def by_rounds(sizes, weights, epochs):
    """Clamp and reshare until none is above."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: epochs * sizes[s] for s in over}


def test_mix_follows_the_rounds(docs):
    got = mixing.mix(docs).toPandas()
    assert "_size" in got.columns and len(got) == docs.count()
    sizes = defaultdict(int)
    for r in got.itertuples():
        sizes[r.source] += r._7
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    want = by_rounds(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got.itertuples():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r._7 * r.copies
        largest[r.source] = max(largest[r.source], r._7)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert Counter(map(repr, again.drop(columns="text").values.tolist())) == Counter(map(repr, got.drop(columns="text").values.tolist()))


def test_rows_of_one_id_are_taken_alike_each_time(spark):
    rows = [(None if i % 2 else 7, f"{i} b", "en", f"s{i % 2}", 0, "") for i in range(60)]
    df = documents(spark, rows)
    picks = [sorted((r.text, r.copies) for r in mixing.mix(df.repartition(n), size=F.lit(2).cast("long"), weights=(1, 3)).collect()) for n in (1, 3, 7)]
    assert picks[0] == picks[1] == picks[2] and len({c for _, c in picks[0]}) > 1


def test_mix_repeats_rows(docs):
    mixed = mixing.mix(docs)
    out = mixing.repeated(mixed, docs.columns)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_mix_of_nothing_and_of_empty_texts(spark, docs):
    assert mixing.mix(docs.where("doc_id = -5")).collect() == []
    rows = mixing.mix(documents(spark, [(1, "", "en", "a", 1, ""), (2, None, "en", "b", 1, "")])).collect()
    assert [(r.target, r.copies) for r in rows] == [(0.0, 0)] * 2
