"""Operator 9: a quality classifier by a factorisation machine.

Features of a text: its words hashed to BUCKETS (square roots of shares), statistics of its structure, and its length as
metadata. The machine is bias + linear terms + pairwise interactions of rank FACTORS, scored in time linear in the
features by the identity sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It learns from at most `sample` labelled rows (a documented bound), those of the smallest hashes of their ids, whose
features come to the driver as `sample` * (BUCKETS + statistics) numbers at most; every document is scored whole, where
it lies, without a shuffle.

Defined results: null text scores as the empty text; documents without label, or whose label is null, aren't learned
from; repeated label rows count once each up to the bound; with labels of one kind only, or none, all score the
smoothed share of ones; repeated rows score alike; only the columns named are read, labels, lang and source never.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, map_batches, read, words_of

BUCKETS, FACTORS, SAMPLE = 512, 8, 8000
#: score >= THRESHOLD is predicted 1.
THRESHOLD = 0.3
_SYMBOLS, _UPPER, _DIGIT = re.compile(r"[#*$%&|<>@^~{}\[\]\\]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]")
STATISTICS = 16


class _Bucket(dict):
    """Word to bucket; forgets when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure and metadata, each about 0 to 1."""
    n, chars = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (STATISTICS - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    per = 1 / max(1, chars)
    ends = sum(w[-1] in ".!?" for w in words) / n
    return [
        0.0,
        min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(chars) / 16),
        min(1.0, chars / n / 20),
        distinct / n,
        min(1.0, np.log1p(distinct) / 12),
        len(_UPPER.findall(text)) * per,
        len(_DIGIT.findall(text)) * per,
        min(1.0, 10 * len(_SYMBOLS.findall(text)) * per),
        min(1.0, 10 * text.count("!") * per),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / n * 5),
        ends,
        sum(not w[-1].isalnum() for w in words) / n,
        words.count("|") / n,
    ]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of BUCKETS + STATISTICS for each text, whole texts."""
    out, bucket = np.zeros((len(texts), BUCKETS + STATISTICS), np.float32), _Bucket()
    for i, text in enumerate(texts):
        words = words_of(text)
        out[i, BUCKETS:] = statistics(text or "", words)
        if words:
            counts = np.bincount(np.fromiter((bucket[w] for w in words_of(ascii_lower(text))), np.int64), minlength=BUCKETS)
            out[i, :BUCKETS] = np.sqrt(counts / counts.sum())
    return out


class Machine:
    """A factorisation machine with logistic output, on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.mean, self.scale, self.bias, self.linear, self.factors = mean, scale, bias, linear, factors

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        pairs = 0.5 * ((z @ self.factors) ** 2 - (z**2) @ (self.factors**2)).sum(axis=1)
        return self.bias + z @ self.linear + pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, rounds: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Adam on the logistic loss; one kind of label only gives the constant smoothed share."""
    d = BUCKETS + STATISTICS
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    none = Machine(np.zeros(d, np.float32), np.ones(d, np.float32), float(np.log(share / (1 - share))), np.zeros(d, np.float32), np.zeros((d, factors), np.float32))
    if not len(y) or y.min() == y.max():
        return none
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    scale = np.maximum(x.std(axis=0), 1e-2) * np.sqrt(np.where(np.arange(d) < BUCKETS, 24.0, 2.0))  # the many words together weigh about as much as the statistics
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    p = [np.array([none.bias]), np.zeros(d), rng.normal(0, 0.01, (d, factors))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        for idx in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            a, t = z[idx], t + 1
            s = a @ p[2]
            logit = p[0] + a @ p[1] + 0.5 * (s**2 - (a**2) @ (p[2] ** 2)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[idx]) / len(idx)
            grads = [np.array([g.sum()]), a.T @ g + decay * p[1], a.T @ (g[:, None] * s) - ((a**2).T @ g)[:, None] * p[2] + decay * p[2]]
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(mean.astype(np.float32), scale.astype(np.float32), float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int) -> DataFrame:
    """text and label (0 or 1) of at most `sample` labelled rows that aren't held out, by the hashes of their ids."""
    few = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("_id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    few = few.withColumn("doc_id", F.col("_id")).where(~held_out).drop("doc_id").orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one row a label


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int = SAMPLE) -> Machine:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = features(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [r.tobytes() for r in x.astype(np.float16)]})

    rows = map_batches(labelled(docs, labels, label, held_out, sample), run, "doc_id long, label int, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "label", "x"], kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float16).astype(np.float32).reshape(len(rows), BUCKETS + STATISTICS)
    return fit(x, rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted: one row for each row."""
    schema = "doc_id long, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                x = features(list(part["text"])).astype(np.float16).astype(np.float32)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": machine.score(x).astype(np.float64)})

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    return score(docs, train(docs, labels, "quality", held_out), held_out)
