"""Operator 5: quality rules from tokeniser fertility, with rejection bands per language.

Base rules count words, symbols, repeated lines and repeated three-word windows. The method then measures each text with
two public vocabularies: characters per token of both, the share of byte-fallback tokens and the entropy of the tokens
of the one with byte fallback. These depend on the language and, for short texts, on the length; so the band of each
measure is median +- WIDTH robust standard deviations (1.4826 MAD, at least FLOOR) of the documents that pass the base
rules, per language and power of two of the token count. They come from histograms over all such documents: each cell
has at most a few thousand bins, whatever the corpus. A cell with fewer than LEAST documents has only the fixed limits.

Defined results: null text has no words; an empty text fails the base rules; a null language is a language; repeated
rows are judged one by one, alike; an empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_RE, map_batches, read, release, small_batches, table, words_of

#: Least words, and the percentage of repeated words above which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bins per unit of the measures, width of the bands, documents that a band needs.
WIDTH, LEAST = 5.0, 50
#: measure: (bins a unit, least robust deviation, fixed low, fixed high)
MEASURES = {"piece_chars": (200, 0.03, 0.5, 12.0), "byte_chars": (200, 0.03, 0.5, 12.0), "byte_share": (1000, 0.01, 0.0, 0.6), "entropy": (100, 0.12, 1.0, 15.0)}
SYMBOLS = "#*$%&|<>"
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k**3 < 1 << 62:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # number the pairs first
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * k + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD_RE.search(line):
            seen.add(line)
    return n


@lru_cache(2)
def _vocabularies(names: tuple[str, str]):  # noqa: ANN202
    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(names[0]))
    is_byte = np.array([piece.is_byte(i) for i in range(piece.get_piece_size())])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(names[1]), "rb"))}
    return piece, is_byte, tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fertility(text: str, names: tuple[str, str] = VOCABULARIES) -> tuple[int, float, float, float, float]:
    """Tokens, characters a token (both vocabularies), byte-fallback share, token entropy in bits."""
    piece, is_byte, byte = _vocabularies(names)
    ids = np.array(piece.encode(text), np.int64)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return len(ids), len(text) / len(ids), len(text) / max(1, len(byte.encode_ordinary(text))), float(is_byte[ids].mean()), float(-(p * np.log2(p)).sum())


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, piece_chars double, byte_chars double, byte_share double, entropy double"


def measured_texts(texts: Iterable[str | None], names: tuple[str, str] = VOCABULARIES) -> pd.DataFrame:
    """The base counts and the measures of whole texts."""
    out = []
    for text in texts:
        text = text or ""
        words = words_of(text)
        n, repeats = len(words), repeated_words(words)
        failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
        base = (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed)
        out.append(base + ((0, 0.0, 0.0, 0.0, 0.0) if failed else fertility(text, names)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def measure(docs: DataFrame, names: tuple[str, str] = VOCABULARIES) -> DataFrame:
    """doc_id, lang, the base counts and the measures: one row for each row; texts that fail the base rules aren't tokenised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = measured_texts(b["text"], names)
            f.insert(0, "lang", b["lang"].to_numpy())
            f.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield f

    schema = "doc_id long, lang string, " + SCHEMA
    return map_batches(docs.select(F.col("doc_id").cast("long"), "lang", "text"), run, schema)



def _cell() -> F.Column:
    return F.struct(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("lang"), F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int").alias("size"))


def bands(measured: DataFrame) -> DataFrame:
    """cell, measure, low, high: from histograms of all documents that pass the base rules.

    A cell has the band of its narrowest pool of LEAST documents: the cell, with the sizes beside it, its language, all.
    """
    good = measured.where("NOT base_failed").select(_cell().alias("cell"), *MEASURES)
    long = good.select("cell", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * MEASURES[m][0]).cast("int").alias("bin")) for m in MEASURES))).alias("x")).select("cell", "x.*")
    bins = long.groupBy("cell", "measure", "bin").agg(F.count("*").alias("n"))

    def pool(level: int, lang: F.Column, size: F.Column) -> F.Column:
        return F.struct(F.lit(level).alias("level"), lang.alias("lang"), size.cast("int").alias("size"))

    lang, size = F.col("cell.lang"), F.col("cell.size")
    wide = [pool(2, lang, F.lit(0)), pool(3, F.lit(""), F.lit(0))]
    into = F.array(pool(0, lang, size), *(pool(1, lang, size + d) for d in (-1, 0, 1)), *wide)
    bins = bins.select(F.explode(into).alias("pool"), "measure", "bin", "n").groupBy("pool", "measure", "bin").agg(F.sum("n").alias("n"))
    per = F.create_map(*(F.lit(x) for m in MEASURES for x in (m, float(MEASURES[m][0]))))
    floor_ = F.create_map(*(F.lit(x) for m in MEASURES for x in (m, MEASURES[m][1])))

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        whole = W.partitionBy("pool", "measure")
        run = df.withColumn("_upto", F.sum("n").over(whole.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("_all", F.sum("n").over(whole))
        return run.withColumn(name, F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col(value))).over(whole)).drop("_upto")

    mid = median(bins, "bin", "mid")
    dev = median(mid.withColumn("off", F.abs(F.col("bin") - F.col("mid"))), "off", "mad")
    stats = dev.groupBy("pool", "measure").agg(F.first("mid").alias("mid"), F.first("mad").alias("mad"), F.first("_all").alias("n"))
    stats = table(measured.sparkSession, stats, "pools")  # a few for each cell
    cells = stats.where("pool.level = 0").select(F.struct("pool.lang", "pool.size").alias("cell"), "measure")
    pools = cells.withColumn("pool", F.explode(F.array(pool(0, lang, size), pool(1, lang, size), *wide)))
    met = pools.join(stats.where((F.col("n") >= LEAST) | (F.col("pool.level") == 3)), ["pool", "measure"])
    stats = met.groupBy("cell", "measure").agg(F.min_by(F.struct("mid", "mad"), "pool.level").alias("x")).select("cell", "measure", "x.*")
    unit = per[F.col("measure")]
    half = WIDTH * F.greatest(1.4826 * F.col("mad") / unit, floor_[F.col("measure")])
    centre = (F.col("mid") + 0.5) / unit
    return stats.select("cell", "measure", (centre - half).alias("low"), (centre + half).alias("high"))


def judge(spark: SparkSession, measured: DataFrame) -> DataFrame:
    """measured with kept: no measure of a kept document lies outside its cell's band or the fixed limits."""
    found = bands(measured).groupBy("cell").agg(*(F.first(F.when(F.col("measure") == m, F.col(e)), ignorenulls=True).alias(f"{e}_{m}") for m in MEASURES for e in ("low", "high")))
    n = (found := table(spark, found, "bands")).count()  # languages times powers of two
    rows = measured.withColumn("_cell", _cell())
    if n <= 10_000:
        rows = rows.join(F.broadcast(found), F.col("_cell") == F.col("cell"), "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).join(found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(63)))), (F.col("_cell") == F.col("cell")) & (F.col("_salt") == F.col("_s")), "left")
    ok = ~F.col("base_failed")
    for m, (_, _, low, high) in MEASURES.items():
        ok &= F.col(m).between(F.coalesce(F.greatest(F.col(f"low_{m}"), F.lit(low)), F.lit(low)), F.coalesce(F.least(F.col(f"high_{m}"), F.lit(high)), F.lit(high)))
    return rows.select(*measured.columns, ok.alias("kept"))


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep. They are written once with their measures; texts are tokenised once and not shuffled."""
    small_batches(spark)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield measured_texts(texts)
        release()

    measures = F.pandas_udf(run, SCHEMA, F.PandasUDFType.SCALAR_ITER)("text")
    rows = table(spark, docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("lang"), measures.alias("_m")), "rows")
    return judge(spark, rows.select("_row", "doc_id", "lang", "_m.*")).where("kept").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(spark, measure(read(spark, sf_dir, "documents")), "measured")
    return judge(spark, measured)
