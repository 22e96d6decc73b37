"""Toxicity of whole texts after noisy-channel deobfuscation: Viterbi over character lattices, then a linear model."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

THRESHOLD = 0.3
#: The classifier is fitted on at most so many labelled rows of each class, those of the smallest md5 of the id.
SAMPLE = 3_000
PREFIXES = range(4, 9)
#: Letters that a character may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c"}
#: Of these, marks that may also part words as they stand.
MARKS = "!|+("
#: Log probability that a writer replaces, repeats, spaces or joins letters.
REPLACED, REPEATED, PARTED = math.log(0.2), math.log(0.3), math.log(0.05)
N_CHARS = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOL = r"[0-9@$!|+(]"
_SPACED = re.compile(rf"(?<![^\W_])(?:[a-z]|{_SYMBOL})(?:[ .\-_*/,~]{{1,2}}(?:[a-z]|{_SYMBOL})(?![^\W_])){{2,}}")
_PARTS = re.compile(r"[ .\-_*/,~]")
_TRIPLE = re.compile(r"([a-z])\1\1")
_LETTER, _REPLACES, _WORDLIKE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_REPLACES[list(map(ord, LEET))] = True
_WORDLIKE[:] = _LETTER | _REPLACES
_WORDLIKE[128:] = True


def count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of three characters in a row of a partition, at most N_CHARS cubed rows."""
    total = np.zeros(N_CHARS**3, np.int64)
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()).to_pylist():
            c = _CLASS[np.frombuffer(b"  " + (text or b"") + b" ", np.uint8)]
            total += np.bincount((c[:-2] * N_CHARS + c[1:-1]) * N_CHARS + c[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["three", "n"])


def log_probabilities(counts: np.ndarray) -> list[float]:
    """Of each character after each two, backed by those after each one; counts of threes, flat, as is the result."""
    three = counts.reshape(N_CHARS, N_CHARS, N_CHARS).astype(float)
    two = three.sum(axis=0) + 1
    backed = two / two.sum(axis=1, keepdims=True)
    return np.log((three + 5 * backed) / (three.sum(axis=2, keepdims=True) + 5)).ravel().tolist()


def character_model(texts: DataFrame) -> list[float]:
    """Log probabilities of each character after each two, from all texts."""
    found = texts.mapInArrow(count_characters, "three long, n long").groupBy("three").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_CHARS**3)
    for three, n in found:
        counts[three] = n
    return log_probabilities(counts)


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def readings(token: str, spaces: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for each run of one character, what it may stand for, with log probabilities.

    A symbol may be any letter it stands for, and some symbols also a gap; a run of three or more may be one letter or
    two, else a run is as long as it stands; with `spaces`, a word may begin at any letter.
    """
    out, at = [], 0
    while at < len(token):
        c, run = token[at], 1
        while at + run < len(token) and token[at + run] == c:
            run += 1
        cost = REPLACED if c in LEET else 0.0
        options = []
        for x in LEET.get(c, c):
            options += [(x, cost + REPEATED), (x * 2, cost + REPEATED)] if run >= 3 else [(x * run, cost)]
        if spaces:
            options += [(f" {x}", w + PARTED) for x, w in options]
        if c in MARKS:
            options.append((" ", cost))
        out.append(options)
        at += run
    return out


def decoded(token: str, lm: list[float], spaces: bool = False) -> str:
    """The likeliest path through a token's lattice, by Viterbi: steps are the token's, states the last two characters.

    The token stands between gaps. Ties go to the reading that comes first. Time and memory grow with the token's length.
    """
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in [*readings(token, spaces), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for x, w in options:
                s, last = score + w, state
                for y in x:
                    at = last * N_CHARS + _code(y)
                    s += lm[at]
                    last = at % (N_CHARS * N_CHARS)
                if last not in after or s > after[last][0]:
                    after[last] = (s, (x, path))
        best = after
    path, out = max(best.values(), key=lambda v: v[0])[1], []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


def odd_spans(raw: bytes) -> tuple[list[tuple[int, int]], bool]:
    """Runs of letters and replacing symbols with both side by side, or a letter three times; and if letters stand alone.

    Marks at a run's ends are left out. All is found by comparing whole arrays of bytes; only what is found is looked at
    one by one.
    """
    a = np.frombuffer(raw, np.uint8)
    if len(a) < 2:
        return [], False
    letter, symbol, word = _LETTER[a], _REPLACES[a], _WORDLIKE[a]
    beside = letter[:-1] & symbol[1:] | symbol[:-1] & letter[1:]
    beside[:-1] |= letter[:-2] & (a[:-2] == a[1:-1]) & (a[1:-1] == a[2:])
    out, done = [], 0
    ends = np.flatnonzero(~(letter | symbol))
    for at in np.flatnonzero(beside).tolist():
        if at < done:
            continue
        i = int(np.searchsorted(ends, at))
        start, done = int(ends[i - 1]) + 1 if i else 0, int(ends[i]) if i < len(ends) else len(a)
        token = raw[start:done].decode()
        first = len(token) - len(token.lstrip(MARKS))
        token = token.strip(MARKS)
        if any(c in LEET for c in token) or _TRIPLE.search(token):
            out.append((start + first, start + first + len(token)))
    alone = word.copy()
    alone[1:] &= ~word[:-1]
    alone[:-1] &= ~word[1:]
    near = np.diff(np.flatnonzero(alone)) <= 3
    return out, bool((near[1:] & near[:-1]).any())


def restored(low: str, lm: list[float]) -> str:
    """A lower-cased text with its odd tokens as they were decoded, and its spaced-out words both joined and parted anew."""
    raw = low.encode()
    spans, spaced = odd_spans(raw)
    text = low
    if spans:
        parts, at = [], 0
        for start, end in spans:
            parts += [raw[at:start].decode(), decoded(raw[start:end].decode(), lm)]
            at = end
        text = "".join([*parts, raw[at:].decode()])
    return _SPACED.sub(lambda m: _read(_PARTS.sub("", m[0]), lm), text) if spaced else text


def _read(joined: str, lm: list[float]) -> str:
    return f"{decoded(joined, lm)} {decoded(joined[1:], lm)} {decoded(joined, lm, spaces=True)}"


def features(word: str) -> list[int]:
    """A word and its beginnings (an inflected word shares its stem), as 32-bit checksums."""
    return [zlib.crc32(f"={word}".encode()), *(zlib.crc32(word[:n].encode()) for n in PREFIXES if n <= len(word))]


def word_set(text: str | None, lm: list[float]) -> set[str]:
    """The words of the restored text."""
    return set(_LETTERS.findall(restored((text or "").lower(), lm)))


@dataclass
class Model:
    lm: list[float]
    bias: float = -math.inf
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[str | None], float]:
        memo: dict[str, tuple[int, ...]] = {}
        weights, lm, bias = self.weights, self.lm, self.bias

        def score(text: str | None) -> float:
            if bias == -math.inf:
                return 0.0
            hit: set[int] = set()
            for w in word_set(text, lm):
                known = memo.get(w)
                if known is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    known = memo[w] = tuple(f for f in features(w) if f in weights)
                if known:
                    hit.update(known)
            z = bias + sum(weights[f] for f in sorted(hit))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def fit(label: np.ndarray, hits: list[list[int]], lm: list[float], share: float) -> Model:
    """A logistic model on presence of features; hits: each row's, share: of toxic rows among all."""
    if not label.any():
        return Model(lm, -40.0 if len(label) else -math.inf)
    if label.all():
        return Model(lm, 40.0)
    weight = np.where(label, share / label.sum(), (1 - share) / (~label).sum()) * len(label)
    chosen = np.unique(np.array([f for h in hits for f in h], np.int64))
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.searchsorted(chosen, np.array([f for h in hits for f in h], np.int64))
    w, bias, total = np.zeros(len(chosen)), math.log(share / (1 - share)), weight.sum()
    y = label.astype(float)
    step_w, step_b = np.zeros(len(chosen)), 0.0
    for _ in range(1500):
        z = bias + np.bincount(row, w[col], len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        step_w = 0.9 * step_w - 2.0 * (np.bincount(col, error[row], len(chosen)) / total + 1e-5 * w)
        step_b = 0.9 * step_b - 1.0 * error.sum() / total
        w, bias = w + step_w, bias + step_b
    return Model(lm, float(bias), {int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4})


def bucket(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 4


def _marks(lm: list[float]) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in word_set(t, lm) for f in features(w)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], ["id", "toxic", "found"])

    return kernel


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The character model of all texts, and the classifier fitted to labelled rows outside the held-out quarter.

    The held-out quarter has crc32(id) mod 4 = 2. Only the text is an input; ids that are null, labels that are null and
    rows without a text teach nothing. At most `sample` rows of each class are taken, by md5 of the id; an id that is
    labelled twice is toxic if one label says so, and of rows that share an id the smallest text counts. Features are words
    and their beginnings in the restored texts, with a support of 3 rows and 1 % of the toxic rows, 70 % of whose weighted
    rows are toxic; Spark counts them, and the driver gets only these features of each sampled row. Long texts are read
    whole. No labels, or no texts, give a model that scores 0. Other columns of both tables, whatever their names, are not
    looked at.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        lm = character_model(texts.select("text"))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (bucket(F.col("id")) != 2)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    rows = texts.where(F.col("text").isNotNull()).join(F.broadcast(pick(1).union(pick(0))), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select(F.col("id").cast("string").alias("id"), "toxic", "text")
    marks = written(rows.mapInArrow(_marks(lm), "id string, toxic int, found array<long>"), "marks")
    have = dict(marks.groupBy("toxic").count().collect())
    share = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-6), 1 - 1e-6)
    bad, good = max(1, have.get(1, 0)), max(1, have.get(0, 0))
    each = marks.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    weighed = F.col("a") * (share / bad)
    chosen = each.where((F.col("a") >= max(3, math.ceil(0.01 * bad))) & (weighed >= 0.7 * (weighed + (F.col("b") + 0.5) * ((1 - share) / good)))).select("f")
    hits = marks.select("id", F.explode("found").alias("f")).join(chosen, "f").groupBy("id").agg(F.array_sort(F.collect_set("f")).alias("hits"))
    got = marks.select("id", "toxic").join(hits, "id", "left").orderBy("id").collect()
    discard(marks)
    return fit(np.array([r["toxic"] for r in got], bool), [r["hits"] or [] for r in got], lm, share)


def score_column(model: Model, text: Column) -> Column:
    """Toxicity from 0 to 1 of the whole text; of null and empty texts, what a text without evidence has. Without labels, 0."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns stay, whatever their names, equal rows share their
    fate, nulls and empty texts score as texts without evidence, and an empty table gives no rows."""
    return docs.where(score_column(train(docs, labels, doc_id, text), F.col(text)) < threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", (bucket(F.col("doc_id")) == 2).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
