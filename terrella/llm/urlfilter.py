"""URL filters: host and path rules, and for the rest trust and distrust propagated over host links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, small, written


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains where the url's path starts with the rule's; its text is host and path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
DAMPING = 0.85
ROUNDS = 20
#: Rounds end when each host's rank changes by less than this share of itself; a host reached for the first time changes by all.
SETTLED = 1e-3
#: Distrust as a share of both, from which a host is blocked.
SHARE = 0.5
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched(host_: Column, path_: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host_ == r.host) | host_.endswith(f".{r.host}")) & path_.startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def host_edges(pages: DataFrame, html: str = "html", own: str = "host") -> DataFrame:
    """(src, dst, links): how often pages of a host link to another host; relative links and links inside a host count not."""
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1)))
    found = pages.select(F.col(own).alias("src"), link.alias("link"))
    found = found.select("src", host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust) of personalised PageRank from seeds (host, trusted, blocked: weights).

    Trust starts at trusted hosts and follows links; distrust starts at blocked hosts and runs against them, to those who
    link there. Each is a distribution: a share 1 - damping returns to the seeds in each round, and so does all that
    reaches a host without further edges. The ranks with that return are those without it, brought to a sum of one, so
    rounds run without it and the sums are taken at the end. Both kinds run in the same joins, keyed by (kind, host).
    Each round is one join of the distinct host edges with the ranks, partial sums per target, and a written table, so
    lineage does not grow and no host's links meet in one task before they are summed. Without edges, hosts keep their
    shares as seeds; without seeds there are no ranks.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    back = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    along = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("links") / F.col("all")).alias("p"))
    against = edges.join(back, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("links") / F.col("all")).alias("p"))
    moves = written(along.union(against), "moves")
    both = seeds.select("host", F.expr("stack(2, 'trust', cast(trusted as double), 'distrust', cast(blocked as double))").alias("kind", "w")).where("w > 0")
    sums = both.groupBy("kind").agg(F.sum("w").alias("total"))
    start = written(both.join(F.broadcast(sums), "kind").groupBy("kind", "host").agg(F.sum(F.col("w") / F.col("total")).alias("r")), "seeds")
    rank = start
    if not moves.isEmpty():
        for _ in range(rounds):
            came = moves.join(rank.select("kind", F.col("host").alias("from"), "r"), ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("p") * F.col("r") * damping).alias("r"))
            kept = start.select("kind", "host", (F.col("r") * (1 - damping)).alias("r"))
            after = written(came.union(kept).groupBy("kind", "host").agg(F.sum("r").alias("r")), "ranks")
            was = rank.select("kind", "host", F.col("r").alias("was"))
            moved = after.join(was, ["kind", "host"], "full").where(F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) >= settled * F.greatest("r", "was"))
            rank = after
            if moved.isEmpty():
                break
    totals = rank.groupBy("kind").agg(F.sum("r").alias("total"))
    rank = rank.join(F.broadcast(totals), "kind").withColumn("r", F.col("r") / F.col("total"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES, share: float = SHARE) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust.

    The longest rule that fits a url decides. Seeds are the hosts of pages that rules allow or block, weighed by their
    pages; a page without a rule is blocked where its host's distrust is at least `share` of trust and distrust together
    (and not 0), else allowed. Null urls, or without ://, have an empty host and path and are allowed; null html has no
    links. Repeated rows count as often as they are there. Very long html is one pass of a regular expression. Extra
    columns stay; clashing names get leading underscores. An empty table gives no rows.
    """
    n_host, n_path, n_rule, n_verdict, n_trust, n_distrust, n_fit, n_key = fresh(pages, "host", "path", "rule", "verdict", "trust", "distrust", "_fit", "_h")
    named = pages.withColumn(n_host, host(F.col(url))).withColumn(n_path, path(F.col(url)))
    named = named.withColumn(n_fit, matched(F.col(n_host), F.col(n_path), rules))
    decided = named.where(F.col(n_fit).isNotNull()).groupBy(F.col(n_host).alias("host"))
    of = lambda v: F.count_if(F.col(f"{n_fit}.verdict") == v)
    seeds = decided.agg(of("allow").alias("trusted"), of("block").alias("blocked"))
    ranks = written(propagate(written(host_edges(named, html, n_host), "edges"), written(seeds, "decided")), "hosts")
    ranks = small(ranks, 320).select(F.col("host").alias(n_key), F.col("trust").alias(n_trust), F.col("distrust").alias(n_distrust))
    joined = named.join(ranks, F.col(n_host) == F.col(n_key), "left")
    distrust, trust = F.coalesce(F.col(n_distrust), F.lit(0.0)), F.coalesce(F.col(n_trust), F.lit(0.0))
    bad = (distrust > 0) & (distrust >= share * (trust + distrust))
    verdict = F.coalesce(F.col(f"{n_fit}.verdict"), F.when(bad, "block").otherwise("allow"))
    return joined.select(*pages.columns, n_host, n_path, F.col(f"{n_fit}.rule").alias(n_rule), verdict.alias(n_verdict), trust.alias(n_trust), distrust.alias(n_distrust))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
