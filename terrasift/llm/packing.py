"""Operator 4: packing by power-of-two decomposition.

Each document's tokens (its ids and one end id) are cut into pieces of 1024 and the binary digits of the rest, longest
first. A piece is a sequence of its own length, so no sequence crosses documents and none is padded; training takes
batches from the bucket of one length at a time. Sequences are numbered along the buckets.

The ids are those of the `tokenizers` library for the vocabulary file; texts without the vocabulary's special strings
are encoded by `tiktoken` from the same vocabulary as ranks, several times as fast, with the same ids (tested).

Defined results: null text is the empty text, of one token (the end id); repeated rows are packed one by one, each into
sequences of its own; documents without an id are packed too; an empty table gives an empty result; only the columns
named are read; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, table

LONGEST, END = 1024, 0
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@lru_cache(1)
def _fast(names: tuple[str, str]):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(names[1]), "rb"))}
    with open(public_tokenizers.path(names[0]), encoding="utf-8") as f:
        special = tuple(t["content"] for t in json.load(f)["added_tokens"])
    return special, tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _slow(name: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def encode(text: str | None, names: tuple[str, str] = VOCABULARY) -> np.ndarray:
    """The document's ids and the end id, as little-endian unsigned 32-bit numbers."""
    special, fast = _fast(names)
    text = text or ""
    ids = _slow(names[0]).encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
    return np.array([*ids, END], "<u4")


def cuts(tokens: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole longest ones, then the binary digits of the rest from the highest."""
    whole, rest = divmod(tokens, longest)
    out = [(i * longest, longest) for i in range(whole)]
    at = whole * longest
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pieces(docs: DataFrame, names: tuple[str, str] = VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (binary, little-endian unsigned 32-bit): a row for each piece."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held = [], 0
            for doc_id, text in zip(b["doc_id"].astype(object), b["text"], strict=True):
                ids = encode(text, names)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for start, length in cuts(len(ids), longest):
                    out.append((doc_id, start, length, len(ids), ids[start : start + length].tobytes()))
                held += len(ids)
                if held > 1 << 21:  # some 8 MB of ids at a time go back to Spark
                    yield frame(out)
                    out, held = [], 0
            if out:
                yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def bucketed(rows: DataFrame) -> DataFrame:
    """Pieces (a written table) dealt out by length, each with its sequence_id; offset is 0, as a piece is a whole sequence.

    The buckets of the lengths, longest first, lie on a line, each as wide as its pieces are large; the line is cut into
    equal partitions, so that a bucket of long pieces goes to as many tasks as its bytes need.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    weight = F.octet_length("ids") + 100 if "ids" in rows.columns else F.lit(1)
    sizes = sorted(((r["length"], float(r["w"])) for r in rows.groupBy("length").agg(F.sum(weight).alias("w")).collect()), reverse=True)  # a row a power of two
    whole, at, where = sum(w for _, w in sizes) or 1.0, 0.0, []
    for length, w in sizes:
        where += [F.lit(length).cast("long"), F.array(F.lit(at / whole), F.lit(w / whole))]
        at += w
    key = F.xxhash64("doc_id", "start")
    place = F.create_map(*where)[F.col("length")] if where else F.array(F.lit(0.0), F.lit(1.0))
    part = F.least(F.floor((place[0] + place[1] * F.pmod(key, F.lit(1 << 20)) / float(1 << 20)) * n), F.lit(n - 1)).cast("int")
    dealt = rows.withColumn("_k", key).withColumn("_p", part).repartitionById(n, F.col("_p")).sortWithinPartitions(F.col("length").desc(), "_k")
    return dealt.drop("_k", "_p").withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def pack(docs: DataFrame, names: tuple[str, str] = VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """All documents as sequences, with their ids and the ids' checksums."""
    rows = table(docs.sparkSession, pieces(docs, names, longest), "pieces")  # read twice: for the sizes, and to be dealt out
    return bucketed(rows.withColumn("ids_crc32", F.crc32("ids")))


def digests(rows: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids, which therefore needn't be shuffled."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once, as the buckets' sizes have to be known before the pieces are dealt out.
    rows = bucketed(table(spark, digests(pieces(read(spark, sf_dir, "documents"))), "pieces"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
