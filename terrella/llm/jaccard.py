"""N-gram Jaccard join of whole texts: grouped prefix join with exact verification, and the components of its links."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, release, small, small_batches, small_methods, written
from .shingles import U64, Late, parities, sets, shingles, slices

WIDTH = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: A task counts shingles in chunks of this many and reports those with at least LEAST in a chunk.
CHUNK, LEAST = 2_000_000, 3
#: So many of the most frequent shingles come last in the global order; the order never changes the result.
LATE = 200_000
#: Buckets whose parities bound the difference of two sets.
BITS = 512
#: Prefixes are longer by 1/SPARE of the size than one shared shingle asks, so that links share that many more.
SPARE = 25
#: Groups that a hash picks for the others of like size to meet.
HEADS = 8
#: Edges that a task joins at a time before they are shuffled.
FOREST = 1_000_000


def _frequent(width: int) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h = np.concatenate([np.empty(0, U64), *held])
            held.clear()
            h.sort()
            token = np.unique(h[LEAST - 1 :][h[LEAST - 1 :] == h[: len(h) - LEAST + 1]]) if len(h) >= LEAST else h[:0]
            n = np.searchsorted(h, token, side="right") - np.searchsorted(h, token)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

        for batch in batches:
            for _, _, texts in slices(batch.column("text")):
                held.append(shingles(texts, width)[1])
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted()
                    size = 0
        yield counted()

    return kernel


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha1(b"".join(parts)).digest()[:8], "little", signed=True)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in parts)])))


def _wide(own: list[np.ndarray]) -> pa.Array:
    """Parities in the power of two of buckets next above the size, of sets of more than 2 * BITS; else null."""
    return pa.array([parities([s], 1 << (len(s) - 1).bit_length())[0].tolist() if len(s) > 2 * BITS else None for s in own], pa.list_(pa.int64()))


def _prefixes(width: int, percent: int, least_first: np.ndarray) -> Callable:
    """Of each row the size, key, group key, prefix, how many of the prefix are not late, and parities of its set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = Late(least_first)
        for batch in batches:
            for a, b, texts in slices(batch.column("text")):
                own = sets(texts, width)
                size = [len(s) for s in own]
                prefix, early = [], []
                for s, n in zip(own, size, strict=True):
                    k = n - -(-n * percent // 100) + 1 + n // SPARE if n else 0
                    first, last = late.split(s)
                    early.append(min(k, len(first)))
                    prefix.append(first[:k] if len(first) >= k else np.concatenate([first, last[: k - len(first)]]))
                key = [_key(s.tobytes()) for s in own]
                group = [_key(x.tobytes(), n.to_bytes(8, "little")) for x, n in zip(prefix, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("digest").slice(a, b - a), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(group, pa.int64()), _lists(prefix), pa.array(early, pa.int32()), _lists(list(parities(own, BITS))), _wide(own)],
                    ["doc_id", "digest", "n", "c", "p", "prefix", "early", "odd", "wide"],
                )

    return kernel


SETS = "doc_id long, digest long, n int, c long, p long, prefix array<long>, early int, odd array<long>, wide array<long>"


def _members(width: int) -> Callable:
    """The sets themselves, by their keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column("text")):
                own = sets(texts, width)
                yield pa.RecordBatch.from_arrays([pa.array([_key(s.tobytes()) for s in own], pa.int64()), _lists(own)], ["c", "members"])

    return kernel


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as a forest with the same components, chunk by chunk: each node and its smallest one."""
    held: list[np.ndarray] = []

    def joined() -> pa.RecordBatch:
        edges = np.concatenate(held) if held else np.empty((0, 2), np.int64)
        held.clear()
        node, at = np.unique(edges, return_inverse=True)
        up = list(range(len(node)))
        for x, y in at.reshape(-1, 2).tolist():
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            up[max(x, y)] = min(x, y)
        root = np.array(up, np.int64)
        while (root != root[root]).any():
            root = root[root]
        own = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)], axis=1))
        if sum(map(len, held)) >= FOREST:
            yield joined()
    yield joined()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b), by alternating large and small stars.

    First each task replaces its edges by a forest, in bounded chunks. Then each round gives every node's larger
    neighbours, then its smaller ones, to the smallest; edges never grow in number. The smallest neighbour of a node is a
    minimum with partial sums and comes back by a join, so the centre of a large star is not one task. Rounds are written
    to the shared folder, until the edges stay the same.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
        seen = both.join(least, F.col("a") == F.col("at")).select("a", "b", "m")
        out = seen.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else seen.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("at"), F.col("m")))
        return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    own = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = written(own.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    state = mark(now)
    while state[0]:
        last, now = now, written(star(star(now, True), False), "edges")
        discard(last)
        if (after := mark(now)) == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _fits(percent: int, n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Length filter, and what can still overlap from these positions on."""
    least = F.ceil((n_a + n_b) * percent / F.lit(100.0 + percent) - 1e-9)
    return (F.greatest(n_a, n_b) * percent <= F.least(n_a, n_b) * 100) & (F.least(n_a - pos_a, n_b - pos_b) >= least)


def _near(percent: int, n_a: Column, odd_a: Column, n_b: Column, odd_b: Column) -> Column:
    """Sets that link differ in at most (n_a + n_b)(100 - percent)/(100 + percent) shingles, and their parities in no more."""
    apart = sum((F.bit_count(F.get(odd_a, F.lit(i)).bitwiseXOR(F.get(odd_b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _near_wide(percent: int) -> Column:
    """The same by wide_a and wide_b; of the longer one, both halves are brought together."""
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(fold("wide_a", "wide_b"), fold("wide_b", "wide_a"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, k: acc + k)
    return F.col("wide_a").isNull() | F.col("wide_b").isNull() | (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


@dataclass
class Join:
    """What rounds of the join start from; sets, members and posted are written tables.

    rows: doc_id, digest, text. sets: of each row its size n, class c and group p. members: of each class n, its group's
    lead class g, a row (m: doc_id, digest) that has it, its smallest id, and its parities. posted: of each group, by its lead class, the
    prefix shingles (token, pos) under which another group stands.
    """

    width: int
    percent: int
    rows: DataFrame
    sets: DataFrame
    members: DataFrame
    posted: DataFrame

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose parities allow a link."""
        side = lambda x: self.members.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"), F.col("wide").alias(f"wide_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(_near(self.percent, F.col("n_a"), F.col("odd_a"), F.col("n_b"), F.col("odd_b")) & _near_wide(self.percent)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) of classes whose sets link, as a written table.

        Sets are made from one text of each class that a pair names, written once, and only travel to their pairs.
        """
        col = F.col
        named = pairs.select(col("a").alias("w")).union(pairs.select(col("b"))).distinct()
        wanted = written(self.members.join(named, col("c") == col("w"), "left_semi").select("c", "m"), "wanted")
        reps = small(wanted, 48).select(col("m.doc_id").alias("d"), col("m.digest").alias("x"))
        texts = self.rows.join(reps, self.rows["doc_id"].eqNullSafe(col("d")) & (self.rows["digest"] == col("x")), "left_semi").select("text")
        with small_batches(pairs.sparkSession):
            full = written(texts.mapInArrow(_members(self.width), "c long, members array<long>"), "members")
        left = full.join(small(pairs, 48), col("c") == col("a")).select("a", "b", col("members").alias("members_a"))
        right = full.join(small(wanted, 48).select(col("c").alias("w")), col("c") == col("w"), "left_semi").select(col("c").alias("b"), col("members").alias("members_b"))
        both = left.join(right, "b").withColumn("shared", F.size(F.array_intersect("members_a", "members_b")))
        linked = both.where(col("shared") * 100 >= (F.size("members_a") + F.size("members_b") - col("shared")) * self.percent)
        out = written(linked.select("a", "b").distinct(), "links")
        discard(wanted, pairs, full)
        return out


def prepared(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> Join:
    """Steps 1 and 2 of classes()."""
    col = F.col
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("digest"), col(text).alias("text"))
    with small_batches(docs.sparkSession):
        counts = rows.select("text").mapInArrow(_frequent(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.desc("n"), "token").limit(LATE).select("token").toArrow()["token"].to_numpy()
        own = written(rows.mapInArrow(_prefixes(width, percent, np.ascontiguousarray(top[::-1]).view(U64)), SETS), "sets")

    held = own.where("n > 0")
    twins = written(held.groupBy(col("p").alias("tp")).agg(F.min(F.struct("c", "doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("tp", "first"), "groups")
    named = held.join(small(twins, 64), col("p") == col("tp"), "left")
    one = named.where(col("tp").isNull() | (col("first.doc_id").eqNullSafe(col("doc_id")) & col("first.digest").eqNullSafe(col("digest")) & (col("first.c") == col("c"))))
    posted = one.select(col("c").alias("g"), "n", "early", F.posexplode("prefix").alias("pos", "token"))
    rare = posted.where("pos < early").withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("groups > 1")
    shared = written(rare.select("token", "g", "n", "pos").union(posted.where("pos >= early").select("token", "g", "n", "pos")), "shared")
    least = F.ceil(col("n") * percent / 100 - 1e-9)
    enough = written(shared.groupBy(col("g").alias("w")).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("k")).where(col("k") > F.floor(least / SPARE)).select("w"), "enough")
    posted = written(shared.join(small(enough, 16), col("g") == col("w"), "left_semi").where(col("pos") <= col("n") - least), "postings")
    discard(shared, enough)
    lead = F.coalesce(col("first.c"), col("c"))
    members = named.groupBy("c").agg(F.first("n").alias("n"), F.first(lead).alias("g"), F.min(F.struct("doc_id", "digest")).alias("m"), F.min("doc_id").alias("id"), F.first("odd").alias("odd"), F.first("wide").alias("wide"))
    members = written(members, "classes")
    discard(twins)
    return Join(width, percent, rows, own, members, posted)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, digest (xxhash64 of the text), n (set size), c (key of the set), component_id.

    1. Order: a pass counts shingles in every task; the 200,000 most frequent of those that a task saw at least three
       times in two million come last, by frequency, all others first, by hash. Any order is exact; this one keeps
       passages that many documents share out of the prefixes. That list, of a fixed bound, is all the driver gets.
    2. Sets: a second pass gives each row its distinct shingles' number, key, prefix and the parities of its shingles'
       numbers in 512 buckets (for more than 1,024 shingles, also in about as many buckets as shingles). The prefix is
       the first n - ceil(0.8 n) + 1 + n / 25 shingles in order: two sets that link share one of the first
       n - ceil(0.8 n) + 1, and of the whole prefix one more for each 25 shingles of the smaller one. Equal sets are one
       class, linked without a comparison; classes with equal prefixes and sizes are one group, and only groups are
       posted. A posting stays if another group stands under its shingle, and a group stays if enough of its postings do.
    3. Stars: among the groups posted under a shingle in a band of like sizes, each meets one that a hash of group and
       shingle picks, so that a group meets some eight others, in bands that overlap; within a group each class meets
       the first. Pairs that pass the length, positional and parity filters are verified on the sets.
    4. The rest: where a shingle, or a group, still holds several components, their cross pairs are expanded to members;
       those that pass the three filters are verified, so that no link between components is missed. Pairs inside a
       component are not listed here: a group of near copies costs stars, not its square. links() lists them.
    5. component_id is the smallest doc_id of the classes that links join.

    Sets and shingles are compared by 64-bit hashes. Texts without words, or null, have n 0 and are linked with nothing.
    Null ids count as no id: a component's id is its smallest other one, or null. Repeated rows are one class and each
    give a row. An empty table gives no rows. Only the id and the text are read; long texts are a slice of their own.
    """
    col, spark = F.col, docs.sparkSession
    join = prepared(docs, doc_id, text, width, percent)
    release(spark)
    members, posted = join.members, join.posted

    linked = join.verified(written(join.possible(_stars(posted, percent).union(members.where("c <> g").select("c", "g"))), "pairs"))
    release(spark)
    roots = components(linked)
    now = members.join(roots, members["c"] == roots["node"], "left")
    now = written(now.select("c", "n", "g", "odd", F.coalesce("root", "c").alias("comp"), col("root").isNotNull().alias("multi")), "joined")
    rest = _across(posted, now, percent)
    with small_methods(spark):
        rest = written(join.possible(rest), "rest")
    release(spark)
    linked = linked.union(join.verified(rest))
    roots = components(linked)

    rooted = members.join(roots, members["c"] == roots["node"], "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = rooted.join(smallest, "root").select("c", "component_id")
    out = join.sets.select("doc_id", "digest", "n", "c").join(ids, "c", "left")
    return out.select("doc_id", "digest", col("n").cast("long").alias("n"), "c", F.when(col("n") == 0, col("doc_id")).otherwise(col("component_id")).alias("component_id"))


def _stars(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups under a shingle with the one that a hash picks there, as far as lengths and positions allow."""
    col = F.col
    turn = F.pmod("token", F.lit(HEADS))
    band = F.floor(F.log(col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.pmod(turn, F.lit(2)) / 2)
    spread = posted.withColumn("band", band)
    heads = spread.groupBy(col("token").alias("t"), col("band").alias("r")).agg(F.min_by(F.struct("g", "n", "pos"), F.struct(F.xxhash64("g", turn), "g")).alias("head"), F.count(F.lit(1)).alias("groups"))
    heads = heads.where("groups > 1").select("t", "r", *[col(f"head.{k}").alias(f"{k}_b") for k in ("g", "n", "pos")])
    met = spread.select("token", "band", *[col(k).alias(f"{k}_a") for k in ("g", "n", "pos")]).join(heads, (col("token") == col("t")) & (col("band") == col("r")))
    return met.where((col("g_a") != col("g_b")) & _fits(percent, col("n_a"), col("pos_a"), col("n_b"), col("pos_b"))).select(col("g_a").alias("a"), col("g_b").alias("b")).distinct()


def _across(posted: DataFrame, now: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes in different components under a shingle or a group that the three filters let pass.

    now: classes c with their component comp, and whether that has more of them (multi). Under a shingle, such a component
    is one row, with the extremes of its members; other classes are rows of their own. Rows meet, single classes under the
    filters themselves, others by what the extremes allow at best; there the smaller component is expanded first, then the
    larger one under the filters.
    """
    col = F.col
    key = ["token", "in_group"]
    inside = now.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(col("g").alias("w"))
    kept = ["c", "n", "pos", "comp", "multi", "odd"]
    in_group = now.join(inside, col("g") == col("w"), "left_semi").select(col("g").alias("token"), F.lit(True).alias("in_group"), "c", "n", F.lit(0).alias("pos"), "comp", "multi", "odd")
    every = posted.select("token", "g", "pos").join(now, "g").select("token", F.lit(False).alias("in_group"), *kept).union(in_group)
    single = every.where("not multi").select(*key, "comp", col("n").alias("lo"), col("n").alias("hi"), col("pos").alias("first"), F.lit(1).cast("long").alias("size"), "c", "odd")
    whole = written(every.where("multi").select(*key, *kept), "spread")
    several = whole.groupBy(*key, "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("first"), F.count(F.lit(1)).alias("size"))
    met = written(single.union(several.select("*", F.lit(None).cast("long").alias("c"), F.lit(None).cast("array<long>").alias("odd"))), "met")
    side = lambda x: met.select(*key, *[col(k).alias(f"{k}_{x}") for k in ("comp", "lo", "hi", "first", "size", "c", "odd")])
    both_single = col("c_a").isNotNull() & col("c_b").isNotNull()
    # A single class goes first, then the smaller component.
    place = lambda x: F.struct(col(f"c_{x}").isNull(), col(f"size_{x}"), col(f"comp_{x}"))
    may = lambda u, v: col(f"first_{u}") * (100 + percent) <= col(f"hi_{u}") * 100 - col(f"lo_{v}") * percent
    singly = _fits(percent, col("lo_a"), col("first_a"), col("lo_b"), col("first_b")) & _near(percent, col("lo_a"), col("odd_a"), col("lo_b"), col("odd_b"))
    across = side("a").join(side("b"), key).where((place("a") < place("b")) & may("a", "b") & may("b", "a") & (~both_single | singly))
    with small_methods(posted.sparkSession):
        across = written(across.select(*key, "comp_a", "comp_b", "c_a", "c_b", col("lo_a").alias("n_a"), col("first_a").alias("pos_a"), "odd_a"), "across")
    end = lambda x: whole.select(*key, *[col(k).alias(f"{k}_{x}") for k in ("comp", "c", "n", "pos", "odd")])
    passed = _fits(percent, col("n_a"), col("pos_a"), col("n_b"), col("pos_b")) & _near(percent, col("n_a"), col("odd_a"), col("n_b"), col("odd_b"))
    ready = ["comp_b", "c_a", "n_a", "pos_a", "odd_a"]
    firsts = across.where("c_a is not null and c_b is null").select(*key, *ready)
    firsts = firsts.union(across.where("c_a is null").select(*key, "comp_a", "comp_b").join(end("a"), [*key, "comp_a"]).select(*key, *ready))
    expanded = firsts.join(end("b"), [*key, "comp_b"]).where(passed).select("c_a", "c_b")
    return across.where("c_b is not null").select("c_a", "c_b").union(expanded).select(col("c_a").alias("a"), col("c_b").alias("b")).distinct()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b), a < b, of class keys, and membership (doc_id, digest, n, c) of every row of docs.

    The filters and the verification are those of classes(); equal sets are one class and are not listed as pairs. The
    pairs are as many as the links between different sets. Nulls, empty texts and repeated rows are as in classes().
    """
    col = F.col
    join = prepared(docs, doc_id, text, width, percent)
    own = join.members.select("c", "g", "n", "odd")
    groups = join.posted.select("token", "g", "pos").join(own, "g").select("token", F.lit(False).alias("in_group"), "c", "n", "pos", "odd")
    inside = own.where("c <> g").select(col("g").alias("w")).distinct()
    inside = own.join(inside, col("g") == col("w"), "left_semi").select(col("g").alias("token"), F.lit(True).alias("in_group"), "c", "n", F.lit(0).alias("pos"), "odd")
    every = groups.union(inside)
    end = lambda x: every.select("token", "in_group", *[col(k).alias(f"{k}_{x}") for k in ("c", "n", "pos", "odd")])
    passed = _fits(percent, col("n_a"), col("pos_a"), col("n_b"), col("pos_b")) & _near(percent, col("n_a"), col("odd_a"), col("n_b"), col("odd_b"))
    pairs = end("a").join(end("b"), ["token", "in_group"]).where((col("c_a") < col("c_b")) & passed).select(col("c_a").alias("a"), col("c_b").alias("b")).distinct()
    with small_methods(docs.sparkSession):
        pairs = written(join.possible(pairs), "pairs")
    return join.verified(pairs), join.sets.select("doc_id", "digest", col("n").cast("long").alias("n"), "c")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (null last) and digest; all columns stay.

    Rows without words are components of their own and stay. Rows that share id and text leave one. Null ids and texts,
    empty tables and long texts are as in classes(); extra columns pass through, whatever their names.
    """
    n_id, n_digest = fresh(docs, "_id", "_digest")
    found = written(classes(docs, doc_id, text, **options).withColumn("group", F.when(F.col("n") > 0, F.coalesce(F.col("component_id"), F.col("c")))).where("group is not null"), "components")
    kept = found.groupBy("group").agg(F.min_by(F.struct("doc_id", "digest"), F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("kept"))
    rest = found.join(kept, "group").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest"))))
    rest = written(rest.select(F.col("doc_id").alias(n_id), F.col("digest").alias(n_digest)).distinct(), "copies")
    same = lambda other: docs[doc_id].eqNullSafe(other[n_id]) & (F.xxhash64(docs[text]) == other[n_digest])
    left = docs.join(small(rest, 64), same(rest), "left_anti")
    twice = written(found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias(n_id), F.col("digest").alias(n_digest)), "repeated")
    if twice.isEmpty():
        return left
    again = lambda how: left.join(small(twice, 64), left[doc_id].eqNullSafe(twice[n_id]) & (F.xxhash64(left[text]) == twice[n_digest]), how)
    (n_text,) = fresh(docs, "_text")
    one = again("left_semi").withColumn(n_text, F.xxhash64(text)).dropDuplicates([doc_id, n_text]).drop(n_text)
    return again("left_anti").unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
