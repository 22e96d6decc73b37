import base64
import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.llm import ann, urlfilter, warc
from terrella.llm.common import shared_path
from test_shards_and_mix import by_rounds
from test_texts import brute_groups, brute_hits, vocabulary

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1200, 16)).astype("f4")
    x[300:700] = x[300]  # one vector holds a third of the rows
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan"), *[1.0] * 15], 1), (5060, [], 1), (5080, [1.0] * 3, 1), (None, [1.0] * 16, 1), (5100, [None, *[1.0] * 15], 1), (5120, [float("inf"), *[1.0] * 15], 1)]
    return spark.createDataFrame(rows + odd, VECTORS), x


def brute_nearest(x, q, k):
    score = x.astype(float) @ x[q].astype(float)
    score[q] = -np.inf
    order = np.lexsort((np.arange(len(x)), -np.round(score, 9)))
    return order[:k].tolist()


def test_recall_and_ties(vectors, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 500)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    df, x = vectors
    rows = ann.nearest(df, df.where("vec_id % 20 = 0"), pivots=64, posted=16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    hits = 0
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-12)
        hits += len({v for _, v, _ in found} & set(brute_nearest(x, q, 20)))
    assert hits >= 0.9 * 20 * len(got)
    assert [v for _, v, _ in got[320]] == brute_nearest(x, 320, 20)


def test_each_dimension_is_searched(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(5)] + [(10 + i, [float(i), 1.0, 2.0], 0) for i in range(3)] + [(20, [1.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in ann.nearest(df, df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {*range(5), 10, 11, 12}
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)] and sorted(got[11]) == [(1, 12, 7.0), (2, 10, 5.0)]


def test_recall_with_the_parameters_of_the_query(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(3_000, 64)).astype("f4")
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in ann.query(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 150 and all(len(v) == 20 for v in got.values())
    assert sum(len(v & set(brute_nearest(x, q, 20))) for q, v in got.items()) >= 0.9 * 20 * 150


def test_few_and_no_vectors(spark, vectors):
    df, _ = vectors
    few = df.where("vec_id < 4")
    assert {(r.query_id, r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0")).collect()} == {(0, 1), (0, 2), (0, 3)}
    assert ann.nearest(df.where("false"), df.where("false")).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 5}.example.com/en/{i}", f"<p>{i % 7}</p>", "x") for i in range(60)] + [(i, "u", "same", "x") for i in range(100, 140)]
    rows += [(200, None, None, "x"), (201, "http://ä.example/ö", "", "x"), (202, "n", "ä" * 300_000, "x"), (139, "u", "same", "x"), (None, "n", "same", "x"), (None, "n", "alone", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, frame string"), rows


def test_archives_come_back(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 4_000)
    df, rows = pages
    root = shared_path(spark, "warc-test")
    index = warc.write_bundles(df, root, bundle_bytes=20_000)
    got = warc.read_bundles(index, root).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {}
    for i, _, h, _ in rows:
        last[digest(h)] = max((v for v in (i, last.get(digest(h))) if v is not None), default=None)
    want = [(i, len((h or "").encode()), d := digest(h), "response" if i == last[d] else "revisit", None if i == last[d] else last[d]) for i, _, h, _ in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert len({r.bundle for r in got}) > 1
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(rows)
    some = sorted(by_id)[::9]
    found = warc.lookup(index, root, spark.createDataFrame([(i,) for i in [*some, "<urn:uuid:none>"]], "record_id string")).collect()
    assert sorted(found) == sorted(by_id[i] for i in some)


def test_archives_of_nothing(spark, pages):
    root = shared_path(spark, "warc-none")
    assert warc.read_bundles(warc.write_bundles(pages[0].where("false"), root), root).collect() == []


def test_seek_table():
    frames = [(10, 100), (7, 70)]
    table = warc.seek_table(frames)
    assert struct.unpack("<I", table[-4:])[0] == 0x8F92EAB1
    assert warc.read_seek_table(table, 17 + 17 + 16) == [(0, 10, 100), (10, 7, 70)]
    with pytest.raises(ValueError):
        warc.read_seek_table(b"\0" * 17, 17)


def test_rules(spark):
    cases = {
        "http://a.example.com/en/7817?x": ("a.example.com", "/en/7817", "example.com/en/7", "allow"),
        "https://B.com/en/9#f": ("b.com", "/en/9", "com/en/", "block"),
        "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://xcom/en/1": ("xcom", "/en/1", None, None),
        "nothing": ("", "", None, None),
        None: ("", "", None, None),
        "http://o.org": ("o.org", "", None, None),
        "ftp://o.org/es/?a://b": ("o.org", "/es/", "org/es/", "block"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    fit = urlfilter.matched(urlfilter.host(F.col("url")), urlfilter.path(F.col("url")))
    for r in df.select("url", urlfilter.host(F.col("url")).alias("h"), urlfilter.path(F.col("url")).alias("p"), fit.alias("f")).collect():
        assert (r.h, r.p, r.f and r.f.rule, r.f and r.f.verdict) == cases[r.url]


def test_trust_runs_along_links_and_distrust_against_them(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts) + '<a href="/own">'
    rows = [(1, "http://good.example.com/en/7", link("friend.io", "friend.io", "both.io")), (2, "http://bad.com/en/1", link("victim.io")), (3, "http://shady.io/a", link("bad.com")), (4, "http://friend.io/a", link("far.io")), (5, "http://victim.io/", ""), (6, "http://far.io/", None), (7, None, link("x.io")), (8, "http://bad.com/other", ""), (8, "http://bad.com/other", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = urlfilter.judge(df)
    assert got.columns == [*df.columns, "_host", "path", "rule", "verdict", "trust", "distrust"]
    verdict = {r.page_id: (r.verdict, r.trust, r.distrust) for r in got.collect()}
    assert len(got.collect()) == len(rows)
    assert {i for i, v in verdict.items() if v[0] == "block"} == {2, 3, 8}
    # Shares of the seeds, what hosts without further links hold included, come back to the seed.
    edges = {("good.example.com", "friend.io"): 2 / 3, ("good.example.com", "both.io"): 1 / 3, ("bad.com", "victim.io"): 1.0, ("shady.io", "bad.com"): 1.0, ("friend.io", "far.io"): 1.0}
    rank = {"good.example.com": 1.0}
    for _ in range(urlfilter.ROUNDS):
        dangling = sum(r for h, r in rank.items() if h not in {a for a, _ in edges})
        after = {"good.example.com": 0.15 + 0.85 * dangling}
        for (a, b), p in edges.items():
            after[b] = after.get(b, 0) + 0.85 * p * rank.get(a, 0)
        rank = after
    assert verdict[4][1] == pytest.approx(rank["friend.io"], abs=2e-3) and verdict[6][1] == pytest.approx(rank["far.io"], abs=2e-3)
    assert urlfilter.judge(df.where("false")).collect() == []


def test_ranks_reach_far_hosts_whatever_else_is_seeded(spark):
    edges = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1) for i in range(5)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("h0", 0, 1), ("alone", 0, 100_000)], "host string, trusted long, blocked long")
    got = {r.host: r.distrust for r in urlfilter.propagate(edges, seeds).collect()}
    assert set(got) == {"alone", *(f"h{i}" for i in range(6))} and sum(got.values()) == pytest.approx(1)
    for i in range(6):
        assert got[f"h{i}"] / got["h0"] == pytest.approx(0.85**i, rel=1e-2)


def test_ranks_like_brute_force(spark):
    r = np.random.default_rng(2)
    hosts = [f"h{i}" for i in range(25)]
    links = {(hosts[a], hosts[b]): int(n) for a, b, n in zip(r.integers(0, 20, 60), r.integers(0, 25, 60), r.integers(1, 5, 60), strict=True) if a != b}
    seeds = [("h1", 3, 0), ("h7", 1, 2), ("h19", 0, 4), ("outside", 1, 1)]
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, links long")
    got = {x.host: (x.trust, x.distrust) for x in urlfilter.propagate(edges, spark.createDataFrame(seeds, "host string, trusted long, blocked long"), rounds=200, settled=1e-9).collect()}
    for kind in (0, 1):
        moves = {((a, b) if kind == 0 else (b, a)): n for (a, b), n in links.items()}
        start = {h: w[kind] / sum(s[1 + kind] for s in seeds) for h, *w in seeds}
        out = {}
        for (a, _), n in moves.items():
            out[a] = out.get(a, 0) + n
        rank = dict(start)
        for _ in range(300):
            lost = sum(v for h, v in rank.items() if h not in out)
            after = {h: w * (0.15 + 0.85 * lost) for h, w in start.items()}
            for (a, b), n in moves.items():
                after[b] = after.get(b, 0) + 0.85 * rank.get(a, 0) * n / out[a]
            rank = after
        for h, v in rank.items():
            assert got.get(h, (0, 0))[kind] == pytest.approx(v, rel=1e-4, abs=1e-9), (h, kind)


def test_the_query_blocks_who_links_to_blocked_hosts(spark, tmp_path):
    link = lambda h: f'<a href="https://{h}/x">x</a>'
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://first.io/", link("bad.com")), (3, "http://second.io/", link("first.io")), (4, "http://good.example.com/en/7", link("third.io")), (5, "http://third.io/", ""), (6, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.verdict for r in urlfilter.query(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_names_of_extra_page_columns_do_not_matter(spark):
    names = ["_h", "_fit", "host", "rule", "verdict", "trust", "distrust", "path", "sha", "payload", "last"]
    df = spark.createDataFrame([(1, "http://a.com/en/", "x"), (2, None, None)], "page_id long, url string, html string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = urlfilter.judge(df)
    assert out.columns[: len(df.columns)] == df.columns and {(r.page_id, r[-3]) for r in out.collect()} == {(1, "block"), (2, "allow")}
    root = shared_path(spark, "warc-names")
    assert warc.read_bundles(warc.write_bundles(df, root), root).count() == 2


def pipeline_tables(spark, folder, docs, labels, items):
    more = "doc_id long, text string, lang string, source string, n_chars long, toxic int, _id long, curve string"
    spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, 5, "c") for i, t, lang, source in docs], more).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def brute_pipeline(docs, toxic, items):
    """What has to be left before mixing: (id, text) of the stages one after another."""
    left = [d for d in docs if not any(w in (d[1] or "") for w in toxic)]
    rows = [(i, t, "") for i, t, _, _ in left]
    groups, _ = brute_groups(rows)
    seen, kept = set(), []
    for (i, t, lang, source), (_, n, group) in sorted(zip(left, groups, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        if n == 0 or group not in seen:
            kept.append((i, t, source))
        if n:
            seen.add(group)
    clean = lambda t: not ((h := brute_hits(t, items))[1] > 0 and 20 * h[1] >= h[0])
    return [(i, t, source) for i, t, source in kept if clean(t)]


def test_pipeline_like_brute_force(spark, tmp_path):
    import corpus_pipeline

    words, r = vocabulary(9, 300)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    toxic = ["zzscum", "zzidiot", "zztrash"]
    docs, labels = [], []
    for i in range(240):
        text = say(40 + i % 30)
        if i % 4 == 0:
            text += f" {toxic[i % 3]} {say(3)}"
        docs.append((i, text, "en" if i % 2 else "de", ("hot", "hot", "b", None)[i % 4]))
        labels.append((i, 1, int(i % 4 == 0)))
    items = [(1, say(30)), (2, say(20)), (3, None), (None, say(15))]
    docs += [(300 + k, docs[1][1] if k % 2 else docs[1][1] + " tail", "en", "b") for k in range(20)]
    docs += [(400, f"{say(10)} {items[0][1]} {say(10)}", "en", "b"), (401, items[1][1], "en", "hot"), (500, None, None, None), (501, "", "en", "b"), (502, "w " * 30_000 + say(20), "en", "b"), (503, "one", "en", "b"), (503, "one", "en", "b")]
    pipeline_tables(spark, str(tmp_path), docs, labels, items)
    before = brute_pipeline(docs, toxic, [x for x in items])
    sf = str(tmp_path)
    stage, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:3]:
        columns = now.columns
        now = corpus_pipeline.written(f(spark, now, sf), name)
        assert now.columns == columns
    got = sorted(((x.doc_id, x.text or "", x.source or "") for x in now.collect()), key=repr)
    assert got == sorted(((i, t or "", source or "") for i, t, source in before), key=repr)
    whole = corpus_pipeline.run(spark, sf)
    rows = whole.collect()
    assert {(x.doc_id, x.text) for x in rows} <= {(i, t) for i, t, _ in before}
    sizes, taken = {}, {}
    for _, t, source in before:
        sizes[source] = sizes.get(source, 0) + len((t or "").split())
    for x in rows:
        taken[x.source] = taken.get(x.source, 0) + len((x.text or "").split())
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    want = by_rounds(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    for s in sizes:
        assert abs(taken.get(s, 0) - want[s]) <= 30_020 / 2
    shards = [x["shard"] for x in rows]
    assert max(map(shards.count, range(16))) - min(map(shards.count, range(16))) <= 1
    del stage


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_heaps_shrink_where_tasks_run(spark):
    from terrella.llm.common import shrink_heaps

    runs = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = runs()
    shrink_heaps(spark)
    assert runs() > before
