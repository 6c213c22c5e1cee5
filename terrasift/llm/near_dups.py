"""Operator 8: SimHash near-duplicates, linked through BK-trees.

A fingerprint bit is set if more than half of the text's shingle hashes have it. Equal fingerprints are one node, known
by its smallest doc_id, so copies never multiply. Fingerprints within RADIUS bits are found in BK-trees: children of a
tree node are keyed by their Hamming distance to it, and a search follows only edges within the radius of its own
distance. One tree over all fingerprints has no size bound, so it can't be broadcast, and a search with radius 3 would
take time that grows nearly as the square of the corpus. The trees are therefore sharded, exactly: of RADIUS + 2 blocks
of bits, two fingerprints within RADIUS bits agree in two at least; each fingerprint goes to a shard for each choice of
two blocks, keyed by those blocks' values, and every linked pair meets in some shard. A shard's tree and its searches
are one group's work. A shard of more than LARGE fingerprints (a dense cluster of copies) is split first: see links().

Links become components by alternating star contractions over node ids; each round's links are a written table, and
only counts come to the driver.

Defined results: null text has no words, as the empty text; texts without words share fingerprint zero and are linked
like others; a row without doc_id has a fingerprint but takes part in no component (null); repeated rows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, attach, map_batches, read, table, words_of

SHINGLE, SEED, RADIUS = 3, 42, 3
#: For deduplication: fingerprints of a text, bits of its signature, bits of it that proposed pairs share (far fewer than the 115 of copies of 0.8, as exact resemblance decides), and words of a shingle.
PRINTS, SIGN_BITS, AGREE, SIGN_SHINGLE = 4, 128, 98, 5
#: Bands of minima over shingles, and minima in each: a pair of resemblance 0.8 has none in common with a chance of 0.0002.
BANDS, BAND = 16, 4
#: Bands that split a band's large shard; a group of at most FEW proposes all its pairs, a larger one a spanning forest and then the rest().
NEXT, FEW = 4, 16
#: Shingles of a piece of an open group: see rest().
PIECE = 1 << 20
#: Shards of more fingerprints than this are split into shards of more equal bits.
LARGE = 2000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the text's shingles, repeats included, as an unsigned 64-bit number."""
    w = words_of(ascii_lower(text)) if text else []
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < size else map(" ".join, zip(*(w[i:] for i in range(size)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, max(1, len(h) // 65536 + 1)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64) if len(part) else 0
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits as they are): one row for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "fingerprint": h})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint long")


class BKTree:
    """A tree of fingerprints: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        self.codes.append(code)
        self.children.append({})
        if len(self.codes) == 1:
            return
        at = 0
        while True:
            d = (self.codes[at] ^ code).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.codes) - 1
                return
            at = self.children[at][d]

    def search(self, code: int, radius: int) -> list[int]:
        """Numbers (in order of addition) of the codes within the radius."""
        out, todo = [], [0] if self.codes else []
        while todo:
            at = todo.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                out.append(at)
            low, high = d - radius, d + radius
            todo += [c for e, c in self.children[at].items() if low <= e <= high]
        return out


class _Sets:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.find(i), self.find(j)))
        self.up[j] = i
        return i != j


def shard_links(codes: list[int], radius: int = RADIUS) -> list[int]:
    """For each code the number of the first code of its component inside the shard."""
    sets, tree = _Sets(len(codes)), BKTree()
    for i, code in enumerate(codes):
        for j in tree.search(code, radius):
            sets.join(i, j)
        tree.add(code)
    return [sets.find(i) for i in range(len(codes))]


def shard_pairs(codes: list[int], s1: np.ndarray, s2: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs with signatures alike of codes that the tree links; codes may repeat."""
    groups: dict[int, list[int]] = {}
    for i, code in enumerate(codes):
        groups.setdefault(code, []).append(i)
    around: dict[int, list[int]] = {}
    for first, own in zip(shard_links(list(groups), radius), groups.values(), strict=True):
        around.setdefault(first, []).extend(own)
    out = []
    for rows in around.values():
        if len(rows) > 1:
            at = np.array(rows)
            out += [(rows[i], rows[j]) for i, j in alike_pairs(s1[at], s2[at])]
    return out


def alike_pairs(s1: np.ndarray, s2: np.ndarray) -> list[tuple[int, int]]:
    """Pairs whose signatures agree in AGREE bits: all of a few rows; else the spanning forest of the likest pairs.

    The pairs of any least resemblance connect the same rows as the forest's pairs of that resemblance.
    """
    n = len(s1)
    if n <= FEW:
        off = np.bitwise_count(s1[:, None] ^ s1) + np.bitwise_count(s2[:, None] ^ s2)
        i, j = np.nonzero(np.triu(off <= SIGN_BITS - AGREE, 1))
        return list(zip(i.tolist(), j.tolist(), strict=True))
    far = 1000
    least, source, out, at = np.full(n, far - 1), np.zeros(n, np.int64), [], 0
    for _ in range(n - 1):
        off = np.bitwise_count(s1 ^ s1[at]).astype(np.int64) + np.bitwise_count(s2 ^ s2[at])
        least[at] = far
        nearer = (off < least) & (least < far)
        least[nearer], source[nearer] = off[nearer], at
        at = int(least.argmin())
        if least[at] <= SIGN_BITS - AGREE:
            out.append((int(source[at]), at))
    return out


def masks_of(free: int, blocks: int, radius: int) -> list[int]:
    """Masks of blocks - radius out of `blocks` even blocks of the free bits: codes within the radius agree under one of them."""
    bits = [i for i in range(64) if free >> i & 1]
    parts = [sum(1 << i for i in part) for part in np.array_split(np.array(bits, object), blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _levels(radius: int) -> list[list[tuple[int, int, int]]]:
    """(choice of the level before, choice, mask of the bits that agree) for each level of shards."""
    whole = (1 << 64) - 1
    levels = [[(0, k, m) for k, m in enumerate(masks_of(whole, radius + 2, radius))]]
    for _ in range(2):
        levels.append([(k, i, m | x) for i, (k, m, x) in enumerate((k, m, x) for _, k, m in levels[-1] for x in masks_of(whole ^ m, radius + 3, radius))])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """(shard, node, code) -> links from each node to the first of its component in the shard; shards are bounded.

    With signatures: proposed pairs; without codes then, whatever is in the shard may be a pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            whole = (b["t"].to_numpy()[1:] != b["t"].to_numpy()[:-1]) | (b["v"].to_numpy()[1:] != b["v"].to_numpy()[:-1])
            starts = np.concatenate([[0], np.flatnonzero(whole) + 1])
            yield linked(b, starts)
            rest = b.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield linked(rest, np.array([0, len(rest)]))

    def linked(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Of the shards that begin at starts; the last start only ends the one before."""
        node, code = b["node"].to_numpy(), b["code"].to_numpy().view(np.uint64) if "code" in b else None
        sign = [b[c].to_numpy().view(np.uint64) for c in ("s1", "s2") if c in b]
        a_out, b_out = [], []
        for i in np.flatnonzero(np.diff(starts) > 1):
            part = slice(starts[i], starts[i + 1])
            own = node[part]
            if not sign:
                pairs = enumerate(shard_links([int(x) for x in code[part]], radius))
            elif code is None:
                pairs = alike_pairs(sign[0][part], sign[1][part])
            else:
                pairs = shard_pairs([int(x) for x in code[part]], sign[0][part], sign[1][part], radius)
            for j, first in pairs:
                if first != j:
                    lo, hi = sorted((int(own[first]), int(own[j])))
                    a_out.append(lo)
                    b_out.append(hi)
        return pd.DataFrame({"lo": np.array(a_out, np.int64), "hi": np.array(b_out, np.int64)})

    dealt = rows.select("shard.t", "shard.v", *(c for c in rows.columns if c != "shard"))
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "v").sortWithinPartitions("t", "v", "node")
    return map_batches(dealt, run, "lo long, hi long")


def links(spark: SparkSession, nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(node, code), codes unique -> links (lo, hi) that connect all codes within the radius of each other.

    With columns s1 and s2, a signature, codes may repeat, and only nodes with signatures alike are proposed. With column
    f, codes of different f have nothing to do with each other (several fingerprints of each node).

    A shard of more than `large` codes goes to the next level, whose shards agree in half of the bits that were free
    before. At the last level at most some ten bits are free, so no shard can hold more than about a thousand codes:
    the groups are bounded, exactly and whatever the data.
    """
    out: DataFrame | None = None
    rows = None
    for level, masks in enumerate(_levels(radius)):
        if rows is None:
            keys = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("v")) for _, k, m in masks)))
            rows = nodes.select("*", keys.alias("shard"))
        else:
            near = F.broadcast(spark.createDataFrame([(up, k, _signed(m)) for up, k, m in masks], "up int, t int, m long"))  # thousands of rows, a constant
            rows = rows.join(near, F.col("shard.t") == F.col("up")).select(*nodes.columns, F.struct("t", F.col("code").bitwiseAND(F.col("m")).alias("v")).alias("shard"))
        if "f" in nodes.columns:
            rows = rows.withColumn("shard", F.struct((F.col("shard.t") + F.col("f") * len(masks)).alias("t"), F.col("shard.v").alias("v")))
        more = None
        if level < 2:
            sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > large).select("shard")
            sizes = table(spark, sizes, "large-shards")
            if n := sizes.count():
                sizes = F.broadcast(sizes) if n <= 10_000 else sizes
                more = table(spark, rows.join(sizes, "shard", "left_semi"), "large")
                if "f" in nodes.columns:
                    more = more.withColumn("shard", F.struct(F.pmod(F.col("shard.t"), F.lit(len(masks))).alias("t"), F.col("shard.v").alias("v")))
                rows = rows.join(sizes, "shard", "left_anti")
        found = _tree_links(rows, radius)
        out = found if out is None else out.unionByName(found)
        if more is None:
            return out
        rows = more
    return out


def band_links(spark: SparkSession, nodes: DataFrame, large: int = LARGE, *, loose: list[DataFrame] | None = None) -> DataFrame:
    """(node, bands, s1, s2) -> pairs (lo, hi) proposed for nodes that have a band in common.

    A shard of more than `large` nodes is split by each of the NEXT bands that follow; what is larger still has eight
    minima alike, and is dealt to pieces of half that size, each two of which meet: no pair of the shard is passed over.
    With a list `loose`, pieces do not meet; links (lo, hi) that hold such a shard together are added to it instead, one a
    node, and whoever calls compares the rest of what they hold together.
    """

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        sizes = table(spark, rows.groupBy("shard").agg(F.count("*").alias("_n"), F.min("node").alias("_first")).where(F.col("_n") > large), "large-bands")
        if not (n := sizes.count()):
            return rows, None
        sizes = F.broadcast(sizes) if n <= 10_000 else sizes
        return rows.join(sizes, "shard", "left_anti"), rows.join(sizes, "shard")

    own = [x for x in nodes.columns if x != "bands"]
    shard = F.struct(F.col("t"), F.col("v")).alias("shard")
    rows = nodes.select(*own, F.posexplode("bands").alias("t", "v")).select(*own, shard)
    rows, more = split(rows)
    out = _tree_links(rows, RADIUS)
    if more is None:
        return out
    more = table(spark, more.drop("_n", "_first"), "large").join(nodes.select("node", "bands"), "node")
    t = F.col("shard.t")
    each = F.explode(F.array(*(F.struct((t + d * BANDS).alias("t"), F.xxhash64("shard.v", F.get("bands", (t + d) % BANDS)).alias("v")) for d in range(1, NEXT + 1))))
    rows, more = split(table(spark, more.select(*own, each.alias("shard")), "split"))
    out = out.unionByName(_tree_links(rows, RADIUS))
    if more is None:
        return out
    n = F.ceil(F.col("_n") / max(1, large // 2)).cast("int")  # three at least
    piece = F.pmod(F.xxhash64("node"), n).cast("int")
    if loose is not None:
        loose.append(table(spark, more.select(F.col("_first").alias("lo"), F.col("node").alias("hi")).where("lo < hi").distinct(), "loose"))
        return out.unionByName(_tree_links(more.select(*own, F.struct(F.col("shard.t").alias("t"), F.xxhash64("shard.v", piece).alias("v")).alias("shard")), RADIUS))
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda k: k != F.col("_i"))
    met = F.explode(F.transform(others, lambda k: F.struct(F.col("shard.t").alias("t"), F.xxhash64("shard.v", F.least("_i", k), F.greatest("_i", k)).alias("v")))).alias("shard")
    return out.unionByName(_tree_links(more.withColumn("_i", piece).select(*own, met), RADIUS))


def proposals(spark: SparkSession, nodes: DataFrame, loose: list[DataFrame] | None = None) -> DataFrame:
    """(node, c0 ..., s1, s2, bands) -> written pairs (lo, hi), each once; for `loose` see band_links()."""
    each = nodes.select("node", "s1", "s2", F.posexplode(F.array(*(f"c{i}" for i in range(PRINTS)))).alias("f", "code"))
    pairs = links(spark, each).unionByName(band_links(spark, nodes.select("node", "s1", "s2", "bands"), loose=loose))
    return table(spark, pairs.where("lo < hi").distinct(), "proposed")


def shingle_sets(spark: SparkSession, docs: DataFrame, ends: DataFrame) -> DataFrame:
    """node, n and own, the sorted distinct shingles of each text, for ids given as (node, n); written."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            sets = [np.unique(shingles(_word_hashes(t, hashes))).tobytes() for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "n": b["n"], "own": sets})

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(ends, "node").select("node", "n", "text")
    return table(spark, map_batches(texts, shingled, "node long, n long, own binary"), "shingles")


def ends_of(pairs: DataFrame) -> DataFrame:
    """(node, n): the ids of the pairs, and in how many each is."""
    return pairs.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def confirmed(spark: SparkSession, docs: DataFrame, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The distinct pairs (lo, hi) of ids whose texts share 0.8 or more of their five-word shingles, counted on the shingles themselves."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["own_lo"], b["own_hi"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) else 0
                keep.append(x.tobytes() == y.tobytes() or 5 * both >= 4 * (len(x) + len(y) - both))
            yield b.loc[keep, ["lo", "hi"]]

    sets = shingle_sets(spark, docs, ends_of(pairs)) if sets is None else sets
    met, n = pairs, pairs.count()
    for end, other in (("lo", "hi"), ("hi", "lo")):
        met = attach(met, sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("own").alias(f"own_{end}")), end, n, f"n_{end}", F.col(other))
    return map_batches(met.select("lo", "hi", "own_lo", "own_hi"), alike, "lo long, hi long")


def group_links(sets: list[np.ndarray], c: np.ndarray, piece: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that share 0.8 or more of their distinct shingles and connect all components c that any such pairs do; with pieces, only pairs of different ones.

    Shingles that more than half of the sets have are counted by who lacks them, so that near copies meet by their
    differences: |x and y| = shared by all - lacking in x - lacking in y + lacking in both + rare ones in both.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = 2 * times > n
    have = np.zeros((n, int(common.sum())), bool)
    have[row[common[col]], (np.cumsum(common) - 1)[col[common[col]]]] = True
    lack_row, lack_col = np.nonzero(~have)
    lacks = np.bincount(lack_row, minlength=n)
    rare = (~common & (times > 1))[col]
    row, col = np.concatenate([lack_row, row[rare]]), np.concatenate([np.flatnonzero(common)[lack_col], col[rare]])
    order = np.argsort(col, kind="stable")
    who, starts = row[order], np.searchsorted(col[order], np.arange(len(times) + 1))
    order = np.argsort(row, kind="stable")
    what, own = col[order], np.searchsorted(row[order], np.arange(n + 1))
    c, out, nobody = np.unique(c, return_inverse=True)[1], [], np.zeros(0, np.int64)
    for i in range(n - 1):
        met = [who[starts[x] : starts[x + 1]] for x in what[own[i] : own[i + 1]]]
        both = np.bincount(np.concatenate(met) if met else nobody, minlength=n)[i + 1 :] + (have.shape[1] - lacks[i] - lacks[i + 1 :])
        near = (9 * both >= 4 * (size[i] + size[i + 1 :])) & (c[i + 1 :] != c[i])
        if piece is not None:
            near &= piece[i + 1 :] != piece[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if c[i] != c[j]:
                out.append((i, j))
                c[c == c[j]] = c[i]
    return out


def rest(spark: SparkSession, pairs: DataFrame, same: DataFrame, sets: DataFrame, loose: list[DataFrame]) -> DataFrame:
    """Links (lo, hi) of near copies that `pairs` (tested) and `same` (those of them that are near copies) leave open.

    A forest connects what the signatures find alike, but where one of its pairs fails, another pair may link the two
    parts. Components between which a pair has failed are an open group, as are those that `loose` holds together: whatever
    could be linked is in one group. There all pairs of different components are compared by their shingles, and only links
    that connect two of them come out. A group of more than PIECE shingles is dealt to pieces, each two of which meet.
    """
    label = components(spark, same).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    failed = pairs.join(same, ["lo", "hi"], "left_anti")
    for x in loose:
        failed = failed.unionByName(x)
    for end in ("lo", "hi"):
        failed = failed.join(label, F.col(end) == F.col("_n"), "left").withColumn(f"_{end}", F.coalesce("_c", end)).drop("_n", "_c")
    failed = table(spark, failed.select(F.least("_lo", "_hi").alias("lo"), F.greatest("_lo", "_hi").alias("hi")).where("lo < hi").distinct(), "failed")
    group = components(spark, failed).select(F.col("node").alias("_n"), F.col("component").alias("_g"))
    open_ = failed.select(F.explode(F.array("lo", "hi")).alias("c")).distinct().join(group, F.col("c") == F.col("_n"), "left").select("c", F.coalesce("_g", "c").alias("g"))
    named = sets.select("node", F.length("own").alias("_size")).join(label, F.col("node") == F.col("_n"), "left").select("node", "_size", F.coalesce("_c", "node").alias("c"))
    named = table(spark, named, "components")
    facts = named.groupBy("c").agg(F.count("*").alias("_m")).join(open_, "c")
    among = table(spark, attach(named, facts, "c", named.count(), "_m", F.col("node")).where("g IS NOT NULL").drop("_m"), "open")
    facts = among.groupBy("g").agg(F.count("*").alias("_m"), F.greatest(F.lit(1), F.ceil(F.sum("_size") / (8 * PIECE))).cast("int").alias("_k"))
    among = attach(among, facts, "g", among.count(), "_m", F.col("node")).groupBy("node", "c", "g").agg(F.max("_k").alias("_k"))
    among = among.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    met = among.select("node", "c", "piece", "g", F.least("piece", "_o").alias("a"), F.greatest("piece", "_o").alias("b"))

    def linked(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """Links of one meeting (g, a, b)."""
        node, c, piece, _, a, b, own = zip(*rows, strict=True)
        if len(set(c)) > 1:
            for i, j in group_links([np.frombuffer(x, np.uint64) for x in own], np.array(c), None if a[0] == b[0] else np.array(piece)):
                yield min(node[i], node[j]), max(node[i], node[j])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        out: list[tuple[int, int]] = []
        for _, meeting in groupby(rows, key=lambda r: r[3:6]):
            out += linked(list(meeting))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["lo", "hi"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["lo", "hi"])

    dealt = met.join(sets.select("node", "own"), "node")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "a", "b").sortWithinPartitions("g", "a", "b", "node")
    return map_batches(dealt, run, "lo long, hi long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Links (lo, hi) -> (node, component) for each node that is linked; the component is its smallest node.

    Alternating stars (Kiveris and others, 2014): each round hangs neighbours on the smallest neighbour, until every
    component is a star. Rounds are aggregates and joins that stand hubs; each round's links are a written table.
    """
    edges = table(spark, edges.where("lo < hi").distinct(), "links")
    while True:
        n = edges.count()
        both = edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionByName(edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")))
        # A star: no node hangs on two, and none that others hang on hangs itself.
        open_ = both.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up = 1 AND down > 0")
        if not n or open_.isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        around = edges.select(F.col("lo").alias("key"), F.col("hi").alias("other")).unionByName(edges.select(F.col("hi").alias("key"), F.col("lo").alias("other")))
        least = around.groupBy("key").agg(F.min("other").alias("_o"), F.count("*").alias("_n")).select("key", F.least("key", "_o").alias("_m"), "_n")
        met = attach(edges.select(F.col("lo").alias("key"), "hi"), least, "key", 2 * n, "_n", F.col("hi"))
        big = table(spark, met.select(F.col("_m").alias("lo"), "hi").where("lo < hi").distinct(), "large-star")
        least = big.groupBy(F.col("hi").alias("key")).agg(F.min("lo").alias("_m"), F.count("*").alias("_n"))
        met = attach(big.select(F.col("hi").alias("key"), "lo"), least, "key", n, "_n", F.col("lo"))
        pairs = met.select(F.explode(F.array(F.struct(F.col("_m").alias("lo"), F.col("key").alias("hi")), F.struct(F.col("_m").alias("lo"), F.col("lo").alias("hi")))).alias("e")).select("e.*")
        edges = table(spark, pairs.where("lo < hi").distinct(), "small-star")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id: one row for each row of docs."""
    marked = table(spark, fingerprints(docs), "fingerprints")
    known = marked.where(F.col("doc_id").isNotNull())
    nodes = table(spark, known.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    found = components(spark, links(spark, nodes.select("node", "code"), radius))
    named = nodes.join(found, "node", "left").select(F.col("code").alias("fingerprint"), F.coalesce("component", "node").alias("component_id"), "n")
    out = attach(marked, named, "fingerprint", marked.count(), "n", F.xxhash64("doc_id"))
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Word to hash; forgets when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return h


def _word_hashes(text: str | None, hashes: _Hashes) -> np.ndarray:
    words = words_of(ascii_lower(text)) if text else []
    return np.fromiter((hashes[w] for w in words), np.uint64, len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of a text with these words, in order of the text; shorter texts are one shingle."""
    if not len(h):
        return h
    k = min(SIGN_SHINGLE, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        s = _mixed(s + h[i : len(h) - k + 1 + i] + _MIX[2])
    return s


def marks(text: str | None, hashes: _Hashes) -> tuple[int, ...]:
    """PRINTS SimHash fingerprints over the text's distinct words, and of its five-word shingles the two halves of a one-bit minhash signature and BANDS bands of BAND minima."""
    h = _word_hashes(text, hashes)
    if not len(h):
        return (0,) * (PRINTS + 2 + BANDS)
    own = np.unique(h)
    out = []
    for f in range(PRINTS):
        ones = np.zeros(64, np.int64)
        x = _mixed(own + np.uint64((f * int(_MIX[2])) & ((1 << 64) - 1)))
        for part in np.array_split(x, len(x) // 65536 + 1):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(own)).astype(np.uint8), bitorder="little").view(np.uint64)[0]))
    s = np.sort(shingles(h))
    bins = (s >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    have, least = bins[first], s[first]
    at = np.searchsorted(have, np.arange(SIGN_BITS))  # an empty bin borrows from the next that isn't
    away = (have[at % len(have)] - np.arange(SIGN_BITS)) % SIGN_BITS
    minima = _mixed(least[at % len(have)] + away.astype(np.uint64) * _MIX[0])
    bits = (minima & np.uint64(1)).astype(np.uint8)
    bands = np.zeros(BANDS, np.uint64)
    for part in minima.reshape(BAND, -1)[:, :: SIGN_BITS // BAND // BANDS]:  # bins far apart: neighbours borrow from the same one
        bands = _mixed(bands + part + _MIX[2])
    return (*out, *(int(x) for x in np.packbits(bits, bitorder="little").view(np.uint64)), *bands.tolist())


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, c0 ... (fingerprints), s1, s2 (signature), bands: one row for each row."""
    names = [*(f"c{i}" for i in range(PRINTS)), "s1", "s2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            m = np.array([marks(t, hashes) for t in b["text"]], np.uint64).reshape(len(b), len(names) + BANDS).view(np.int64)
            out = pd.DataFrame(m[:, : len(names)], columns=names)
            out["bands"] = list(m[:, len(names) :])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without copies and near copies: of each group the row of the smallest doc_id stays.

    Near copies share 0.8 or more of their five-word shingles. They are proposed by SimHash fingerprints over distinct
    words, in which copies with scattered changes differ by about four bits of 64, and by bands of minima over the
    shingles, which find them wherever the changes lie. Signatures of the shingles drop most of what is proposed, and
    the shingles themselves decide. Rows without doc_id all stay. Documents are known by their ids: where an id stays, so
    does one row of each of its texts.
    """
    seen = table(spark, marked(docs.where(F.col("doc_id").isNotNull())), "marks")
    codes = [f"c{i}" for i in range(PRINTS)]
    nodes = table(spark, seen.groupBy(*codes, "s1", "s2").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    loose: list[DataFrame] = []
    pairs = proposals(spark, nodes, loose)
    ends = ends_of(pairs)
    for x in loose:
        ends = ends.unionByName(ends_of(x).withColumn("n", F.lit(0).cast("long"))).groupBy("node").agg(F.sum("n").alias("n"))
    sets = shingle_sets(spark, docs, ends)
    same = table(spark, confirmed(spark, docs, pairs, sets), "near")
    more = rest(spark, pairs, same, sets, loose)
    found = components(spark, same.unionByName(more))
    stay = nodes.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left_anti").select(F.col("node").alias("_stay"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_x"), F.struct("*").alias("_row"))
    kept = rows.where("_id IS NOT NULL").join(stay.hint("merge"), F.col("_id") == F.col("_stay"))
    one = kept.withColumn("_r", F.lag(F.lit(1)).over(W.partitionBy("_stay", "_x").orderBy("_stay"))).where("_r IS NULL")
    return one.select("_row.*").unionByName(rows.where("_id IS NULL").select("_row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, read(spark, sf_dir, "documents"))
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
