"""Secret scans: candidate strings with their surroundings, judged by a random forest written out as SQL."""

from __future__ import annotations

import json
import random
import string
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

LONG, SHORT = 16, 8
THRESHOLD = 0.5
TREES, DEPTH = 24, 6
#: Generated labelled findings; the bound of what the forest is fitted to.
FINDINGS, SEED = 2_400, 7
_CHARS = "[A-Za-z0-9+/=_-]"
_OTHERS = "[^A-Za-z0-9+/=_-]"
#: What parts a name from its value, and values from each other.
_BREAKS, _VALUE = "[\"'=:;,]", "[^\"'=:;,]"
#: Items whose sizes are summed at once where a place in a long text or piece is looked up.
BLOCK = 256
#: Letters, then digits, then all else.
SYMBOLS = 28
#: Words of names, prose and placeholders; what they cover of a candidate speaks against it. Fixed values.
DICTIONARY = "about account address admin after again array because before build button bytes class client cloud color config content count create data date default delete document domain download engine error event example false field file filter first format from function group handle hash header hello home image index input item keyboard label language length level library license line link list local login main manager message method model module name node number object option order other output page param parent password path people place plugin point private process project public query random record release request resource response result return sample schema screen script search secret select server service session simple size source start state status step string style system table target task template test text their there thing this time title token type update upload user value version view virtual window with word world write your".split()
GOOD_WORDS = "token|secret|passw|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth|bearer|client[_-]?secret"
BAD_WORDS = "example|sample|dummy|placeholder|changeme|your[_-]|sha1|sha256|md5|checksum|digest|commit|revision|uuid|guid|etag|integrity|nonce|hash"
FEATURES = ("length", "digits", "upper", "vowels", "transitions", "runs", "distinct", "entropy", "covered", "hex", "separators", "key_word", "assigned", "plain_word", "test_path")


def features(value: Column, before: Column, after: Column, path: Column, transitions: tuple[float, ...]) -> dict[str, Column]:
    """Numbers about a candidate (not empty), the words before and after it, and where its text comes from."""
    pairs = F.split(F.lit(",".join(f"{v:.4f}" for v in transitions)), ",").cast("array<double>")
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), F.lit(26)).otherwise(F.lit(27))
    codes = F.transform(F.filter(F.split(F.lower(value), ""), lambda c: c != ""), code)
    steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.coalesce(F.element_at(pairs, a * SYMBOLS + b + 1), F.lit(0.0)))
    n = F.char_length(value).cast("double")
    gone = lambda pattern: (n - F.char_length(F.regexp_replace(value, pattern, ""))) / n
    low = F.lower(value)
    near, place = F.lower(F.concat_ws(" ", before, after)), F.lower(F.coalesce(path, F.lit("")))
    flag = lambda c: c.cast("double")
    share = lambda ch: (n - F.char_length(F.replace(value, ch, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    return {
        "length": n,
        "digits": 1 - gone("[^0-9]"),
        "upper": 1 - gone("[^A-Z]"),
        "vowels": 1 - gone("[^aeiouAEIOU]"),
        "transitions": F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v) / F.greatest(n - 1, F.lit(1.0)),
        "runs": F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")).cast("double") / n,
        "distinct": F.size(letters) / F.least(n, F.lit(64.0)),
        "entropy": F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))),
        "covered": 1 - F.char_length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "separators": 1 - gone("[^_/=+.-]"),
        "key_word": flag(near.rlike(GOOD_WORDS)),
        "assigned": flag(before.rlike("[:=>(]\\s*[\"']?$")),
        "plain_word": flag(near.rlike(BAD_WORDS) | low.rlike("example|your|xxxx|placeholder|changeme|dummy")),
        "test_path": flag(place.rlike("test|spec|fixture|example|sample|mock|docs?/")),
    }


def _blocks(sizes: Column) -> Column:
    """Sums of an array of sizes, BLOCK items at a time."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda b: _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def _place(sizes: Column, blocks: Column, at: Column) -> Column:
    """The sum of the sizes before an item, by whole blocks and what is left."""
    whole = F.floor(at / BLOCK).cast("int")
    return _sum(F.slice(blocks, F.lit(1), whole)) + _sum(F.slice(sizes, whole * BLOCK + 1, at - whole * BLOCK))


def candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, start and end (characters), value, before, after: every possible secret of every whole text, each occurrence.

    Texts are cut at runs of white space. Candidates of a piece are its runs of 16 or more characters of keys, each value
    of 8 or more that is assigned in it (`key=`, `key:`, quotes in between), its first one where the piece before ends in an
    assignment, and its last one if it holds no such run and it, or the piece before, has an assignment. Three pieces
    before and one after are its surroundings. Each text is one pass through the array of its pieces, and each piece one
    through its runs, without a shuffle; places are sums of sizes, taken block by block, so long texts and pieces cost
    little more than their length. Names of kept columns do not matter. Null and empty texts have no candidates.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D]", " ")
    # Each piece starts with its white space, which keeps its place in the text; all pieces together are the text.
    pieces = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.regexp_extract_all(flat, F.lit(" *[^ ]+"), F.lit(0)).alias("whole"))
    pieces = pieces.withColumn("sizes", F.transform("whole", lambda w: F.char_length(w))).withColumn("blocks", _blocks(F.col("sizes")))
    at = pieces.select("*", F.posexplode("whole").alias("at", "spaced")).withColumn("piece", F.ltrim("spaced"))
    back = lambda i: F.when(F.col("at") >= i, F.ltrim(F.get(F.col("whole"), F.col("at") - i))).otherwise(F.lit(""))
    opens = back(1).rlike("[:=][\"']?$")
    runs = F.col("piece").rlike(f"{_CHARS}{{{LONG}}}")
    at = at.where((F.char_length("piece") >= SHORT) & (runs | F.col("piece").rlike("[:=]") | opens))
    at = at.withColumn("runs", F.regexp_extract_all("piece", F.lit(f"{_CHARS}+|{_OTHERS}+"), F.lit(0)))
    at = at.withColumn("parts", F.regexp_extract_all("piece", F.lit(f"{_BREAKS}+|{_VALUE}+"), F.lit(0)))
    longs = F.filter(F.transform("runs", lambda v, i: F.struct(F.lit(True).alias("of_runs"), i.alias("i"), v.alias("value"))), lambda s: (F.char_length(s["value"]) >= LONG) & s["value"].rlike(f"^{_CHARS}"))
    part = lambda i: F.coalesce(F.get(F.col("parts"), i), F.lit(""))
    assigned = lambda s: part(s["i"] - 1).rlike("^[\"']?[:=]{1,2}[\"']?$") & part(s["i"] - 2).rlike("[A-Za-z0-9_]$") & ~s["value"].startswith("/")
    first = lambda s: F.col("opens") & ((s["i"] == 0) | (s["i"] == 1) & part(F.lit(0)).rlike("^[\"']$"))
    last = lambda s: F.col("ends") & ((s["i"] == F.size("parts") - 1) | (s["i"] == F.size("parts") - 2) & part(F.size("parts") - 1).rlike("^[\"';,]+$"))
    at = at.withColumn("opens", opens).withColumn("ends", ~runs & (opens | F.col("piece").rlike(r"[A-Za-z_][\"']?[:=][\"']?[^\s\"'/]")))
    shorts = F.filter(F.transform("parts", lambda v, i: F.struct(F.lit(False).alias("of_runs"), i.alias("i"), v.alias("value"))), lambda s: (F.char_length(s["value"]) >= SHORT) & s["value"].rlike(f"^{_VALUE}") & (assigned(s) | first(s) | last(s)))
    placed = lambda c, s: _place(F.transform(c, lambda v: F.char_length(v)), _blocks(F.transform(c, lambda v: F.char_length(v))), s["i"])
    found = at.withColumn("s", F.explode(F.concat(longs, shorts))).withColumn("value", F.regexp_replace("s.value", "(?<=.{8})[).]+$", ""))
    found = found.withColumn("off", F.when(F.col("s.of_runs"), placed("runs", F.col("s"))).otherwise(placed("parts", F.col("s"))))
    # A run and a part may be the same place and value; the run stands for both.
    same = F.exists(F.array_distinct(F.transform(longs, lambda s: F.struct(placed("runs", s).alias("off"), s["value"].alias("value")))), lambda s: (s["off"] == F.col("off")) & (s["value"] == F.col("value")))
    found = found.where(F.col("s.of_runs") | ~same)
    start = _place(F.col("sizes"), F.col("blocks"), F.col("at")) + F.char_length("spaced") - F.char_length("piece") + F.col("off")
    before = F.concat_ws(" ", back(3), back(2), back(1), F.expr("substring(piece, 1, off)"))
    after = F.concat_ws(" ", F.expr("substring(piece, off + 1 + char_length(value))"), F.coalesce(F.ltrim(F.get(F.col("whole"), F.col("at") + 1)), F.lit("")))
    out = found.select(*kept, start.cast("long").alias("start"), (start + F.char_length("value")).cast("long").alias("end"), "value", before.alias("before"), after.alias("after"))
    return out.toDF(*keep, "start", "end", "value", "before", "after")


#: Words of generated findings that are no secrets.
VOCABULARY = "absolute active agent alert align amount anchor apply archive asset attach audio average axis badge bank base batch binary block border bottom branch brand broker browser buffer bundle button cache calendar camera cancel canvas cart catalog center chain channel chart check child choose circle clean clear click clone close cluster collect column command comment compare connect console contact control convert copy core count cursor custom damage dash deep delay depth detail device dialog direct disk display dock domain draft drive driver drop edge edit effect email enable encode entity entry epoch equal escape export extra fetch final finish fixed flag float flow flush focus folder force fork forward frame front gate general global grant graph grid group guard guide half hidden history hold hook hour house icon image import inner insert inside install invoice join jump keep kernel kind label large last launch layer layout lazy leaf left legacy limit linear loader local lock logger lookup loop map margin market mask master match media member merge metric middle mobile modal monitor month motion mount mouse move native network next night notify offset open orange origin outer owner pack panel parse patch pause period phone photo pixel place plain plan plate play plus pool popup port post power press price print profile prompt proxy public pull push quick radio range rate ratio reader ready record reduce region remote remove render repeat reply report reset resize resolve rest retry right role root round route sample save scale scan scope scroll seed send shadow shape share sheet shift side sign skip slide slot small smooth snap socket sort source space span split stack stage stamp stop store stream strict stroke submit suffix sum swap sync tail term text thread tick tile timer toggle tool top total touch trace track trade train tree trim trigger tuple turn unique unit unlock update usage vector video visit volume wait walk wall watch wave web week weight width wrap zero zone".split()


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[dict]:
    """Generated findings as a reviewer would label them: keys of usual shapes, and what only looks like one.

    Their words are VOCABULARY and syllables, not the dictionary that a feature looks up.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "an ar be ch de en er es ge in is le li lo ma me mo na ne on or ou pa ra re ri sa se st te ti to un ve".split()
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    keys = ["token =", "api_key =", "secret:", "password =", "auth_token:", "client_secret =", "Authorization: Bearer", "access_key =", "export API_KEY="]
    plain = ["of the", "see", "and then", "in", word(2), f"{word(2)}, {word(3)}"]
    good_shapes = [lambda: pick(hexes, r.choice([32, 40, 64])), lambda: pick(alnum, r.randint(20, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 48), lambda: pick(alnum + "+/", r.randint(30, 60)) + "==", lambda: pick(alnum + "_-", r.randint(22, 43)), lambda: pick(alnum, r.randint(10, 15))]
    bad_shapes = [
        lambda: (word(r.randint(7, 14)), r.choice(plain)),
        lambda: (word(r.randint(7, 14)).capitalize(), r.choice(plain)),
        lambda: ("_".join([r.choice(VOCABULARY) for _ in range(r.randint(3, 5))]), r.choice([*plain, *keys])),
        lambda: ("-".join([word(2) for _ in range(r.randint(3, 6))]), r.choice(plain)),
        lambda: ("/".join([r.choice(VOCABULARY) for _ in range(r.randint(3, 5))]), r.choice([*plain, "path =", "url:"])),
        lambda: ("".join(r.choice(VOCABULARY).capitalize() for _ in range(r.randint(3, 5))), r.choice([*plain, *keys])),
        lambda: (pick(hexes, r.choice([32, 40, 64])), r.choice(["commit", "sha1:", "sha256:", "md5 =", "checksum:", "etag:", "revision"])),
        lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid:", "guid =", *plain])),
        lambda: (pick(string.digits, r.randint(16, 24)), r.choice([*plain, "id:", "number"])),
        lambda: (r.choice(["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLEKEYEXAMPLEKEY", "changeme_changeme", "placeholder_token_value", "<your-secret-token>"]), r.choice(keys)),
        lambda: (r.choice("-=_") * r.randint(16, 60), r.choice(plain)),
        lambda: (r.choice(VOCABULARY) + r.choice(VOCABULARY), r.choice(["type =", "name:", "value =", "mode:"])),
    ]
    out = []
    for i in range(n):
        if i % 2:
            strong = r.random() < 0.85
            value, before = r.choice(good_shapes)(), r.choice(keys) if strong else r.choice(plain)
            label = int(strong or len(value) >= 20 and r.random() < 0.9)
            path = r.choice(["src/app.py", "deploy/prod.env", "src3", "web", "notes.txt"])
        else:
            (value, before), label = r.choice(bad_shapes)(), 0
            path = r.choice(["src/app.py", "tests/test_login.py", "docs/guide.md", "src7", "web"])
        out.append({"value": value, "before": before + r.choice([" ", ' "', ""]).rstrip() if before in keys else before, "after": r.choice(["", '"', word(2)]), "path": path, "label": label})
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple | float:
    """A tree of (feature, threshold, left, right) with shares of positives at its leaves; Gini, a random third of features."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return float(y.mean())
    best = (1e-9, None)
    here = 2 * y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False).tolist():
        for t in np.unique(np.round(np.quantile(x[:, f], np.linspace(0.04, 0.96, 20)), 6)):
            left = x[:, f] <= t
            k = left.sum()
            if 3 <= k <= len(y) - 3:
                p, q = y[left].mean(), y[~left].mean()
                gain = here - (k * 2 * p * (1 - p) + (len(y) - k) * 2 * q * (1 - q)) / len(y)
                if gain > best[0]:
                    best = (gain, (f, float(t)))
    if best[1] is None:
        return float(y.mean())
    f, t = best[1]
    left = x[:, f] <= t
    return f, t, grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1)


def as_sql(tree: tuple | float) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, t, left, right = tree
    return f"if({FEATURES[f]} <= {t!r}D, {as_sql(left)}, {as_sql(right)})"


def pair_weights(findings: list[dict]) -> tuple[float, ...]:
    """How much each symbol after each speaks for a secret: log odds of the findings' transitions, add-half smoothed."""
    counts = np.full((2, SYMBOLS, SYMBOLS), 0.5)
    code = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26 if "0" <= c <= "9" else 27
    for x in findings:
        own = [code(c) for c in x["value"].lower()]
        for a, b in zip(own[:-1], own[1:], strict=True):
            counts[x["label"], a, b] += 1
    share = counts / counts.sum(axis=2, keepdims=True)
    return tuple(float(v) for v in np.log(share[1] / share[0]).ravel())


@dataclass(frozen=True)
class Forest:
    """SQL over the features that gives the share of votes, and the transition weights that one feature sums."""

    votes: str
    transitions: tuple[float, ...]


def train(spark: SparkSession, findings: list[dict] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """A forest fitted on the driver. findings (value, before, after, path, label) default to generated ones; at most 2,400
    of them are used, those first given: by turns two teach the transitions and two the trees."""
    rows = (findings if findings is not None else generated())[:FINDINGS]
    transitions = pair_weights([x for i, x in enumerate(rows) if i // 2 % 2 == 0])
    kind = "array<struct<value:string,before:string,after:string,path:string,label:int>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([x for i, x in enumerate(rows) if i // 2 % 2])), kind)).alias("r")).select("r.*")
    of = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), transitions)
    got = np.array(table.select(*[of[f].alias(f) for f in FEATURES], F.col("label").cast("double")).collect(), float)
    x, y, rng = got[:, :-1], got[:, -1], np.random.default_rng(seed)
    votes = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        votes.append(as_sql(grow(x[own], y[own], rng, depth)))
    return Forest("(" + " + ".join(votes) + f") / {trees}D", transitions)


@cache
def _generated() -> str:
    return json.dumps(labelled_findings())


def generated() -> list[dict]:
    return json.loads(_generated())


ADDED = ("start", "end", "value", *FEATURES, "score", "is_secret")


def scan_secrets(docs: DataFrame, text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",), forest: Forest | None = None) -> DataFrame:
    """Per candidate: the kept columns, start, end, value, its features, score (0 to 1) and is_secret (score >= 0.5).

    Built-in expressions only: the forest, fitted on the driver to a bounded set of labelled findings, is nested ifs.
    Null and empty texts have no candidates; a null path is no test path; long texts are read whole. Repeated rows repeat
    their findings; added names that kept columns have already get leading underscores. No rows give no rows.
    """
    forest = forest or train(docs.sparkSession)
    names = fresh(docs.select(*keep), *ADDED)
    own = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, own, strict=True)], F.col(path).alias("path"), F.col(text).alias("text"))
    found = candidates(slim, "text", [*own, "path"])
    of = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), forest.transitions)
    scored = found.select(*own, "start", "end", "value", *[of[f].alias(f) for f in FEATURES]).withColumn("score", F.round(F.expr(forest.votes), 6))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD).toDF(*keep, *names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan_secrets(docs)
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
