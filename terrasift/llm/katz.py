"""Operator 3: scoring by a Katz backoff model over words, with Good-Turing discounts.

Tokens are a text's words in lower case and one end. No word is merged with another: all tokens of the training texts
and all their bigrams are counted.

- P(w | v) of a seen bigram: d_n n / (n(v) + 1/2), with the Good-Turing discount d_n of counts up to MOST;
- of an unseen one: alpha(v) P(w), where alpha(v) makes the probabilities after v sum to one exactly;
- P(w): d_n n / N; the unknown token has the Good-Turing remainder. After a word that training has not, P(w) itself.
Where Good-Turing isn't defined (too few counts) half a count is taken off instead. The half that n(v) gets keeps some
probability for what wasn't seen after contexts without small counts.

How it is dealt out. Each task makes batches of about BATCH tokens: its texts as numbers into the batch's own list of
words. Lists of words, and then of bigrams, go as packed arrays to buckets by hash, where the batches' counts are added;
of a word or a bigram a bucket gets one entry a batch, however often it occurs. Bigrams go by their context, so that a
bucket has whole contexts and makes their alphas; those of heavy contexts (the HOT most frequent words, others of over
HEAVY tokens, the start) go by both words, and these contexts' sums, HEAD + 1 at most, are added up apart. Bigrams of two
of the HOT words that are seen more than MOST times, HOT * (HOT + 1) at most, need no discount: they are broadcast and
never dealt out. So no bucket gets much more than its share, and nothing broadcast or collected grows with the corpus.

The table of unigrams numbers the words, so that a word takes few bytes. The table of bigrams (part, bucket; contexts, words, counts) is written, partitioned by part; each bucket's requests stand
beside its bigrams, so that scoring it sums log probabilities for each document without a further join.

Defined results: null text is the empty text, of one token; repeated rows are scored, and learnt from, one by one;
null ids count as the empty text for the folds; without training rows all base scores are 0; only the columns named are
read. Words are known by their 63-bit hashes until they have numbers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, batch_rows, collect_garbage, crc_mod, delete, map_batches, read, scratch_path, table, words_of

MOST, HEAD, HOT = 5, 65_536, 1024
#: Tokens and documents of a batch; tokens of a bucket on average; buckets at least; tokens that make a context heavy; parts of the bigrams' table.
BATCH, BATCH_DOCS, BUCKET, BUCKETS, HEAVY, PARTS = 2_000_000, 60_000, 1_000_000, 64, 250_000, 16
#: The end's hash is that of a line feed, which is in no word. The start is a context only.
END, START = "\n", HEAD
_TOP = 1 << 63


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) | _TOP


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each byte's place of the numbers by itself, compressed."""
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes, *planes]))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, int(n) * width, at).reshape(width, int(n))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += int(n) * width
    return out


def discounts(counts: dict[int, int], most: int = MOST) -> np.ndarray:
    """Good-Turing discounts d_0 ... d_most (d_0 unused) from counts of counts; (r - 1/2) / r where they aren't defined."""
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, most + 1))])
    n = [counts.get(r, 0) for r in range(most + 2)]
    if all(n[1:]):
        last = (most + 1) * n[most + 1] / n[1]
        if last < 1:
            exact = [((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) for r in range(1, most + 1)]
            d[1:] = [e if 0 < e < 1 else f for e, f in zip(exact, d[1:], strict=True)]
    return d


def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(n <= MOST, d[np.minimum(n, MOST)], 1.0) * n


class Unigrams:
    """The lower order: totals, discounts, and hashes, numbers and counts of the most frequent words."""

    def __init__(self, n: int, v: int, small: dict[int, int], head: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> None:
        self.n, self.v, self.d, self.counts, self.hot = n, v, discounts(small), counts, head[:HOT]
        self.order = np.argsort(numbers)
        self.sorted = numbers[self.order]
        off = sum(small.get(r, 0) * r * (1 - self.d[r]) for r in range(1, MOST + 1))
        self.total = n if off else n + 0.5  # no small counts: half a count for the unknown token
        self.unknown = (off or 0.5) / self.total

    def p(self, n: np.ndarray) -> np.ndarray:
        """P(w) by the token's count; 0: unknown."""
        return np.where(n > 0, discounted(n, self.d) / self.total, self.unknown)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """Ranks of the words of the head, the numbers of all others."""
        if not len(self.sorted):
            return numbers
        at = np.minimum(np.searchsorted(self.sorted, numbers), len(self.sorted) - 1)
        return np.where(self.sorted[at] == numbers, self.order[at], numbers)


def batches(docs: DataFrame, train: Column) -> DataFrame:
    """A row a batch: its documents, their tokens as numbers of the batch's words (the most frequent first), and the words by hash: their numbers, and their counts in training."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number = TaskContext.get().partitionId() << 32, itertools.count()
        words, ids, held, tokens, size = _Numbers(), [], [], [], 0
        for b in parts:
            for i, null, text, out in zip(b["id"], b["null"], b["text"], ~b["train"], strict=True):
                w = words_of(ascii_lower(text)) if text else []
                tokens.append(np.fromiter(map(words.__getitem__, itertools.chain(w, (END,))), np.int32, len(w) + 1))
                ids.append(-1 if null else i)
                held.append(out + 2 * null)
                size += len(w) + 1
                if size >= BATCH or len(ids) >= BATCH_DOCS:
                    yield made(first + next(number), words, ids, held, tokens)
                    words, ids, held, tokens, size = _Numbers(), [], [], [], 0
        if ids:
            yield made(first + next(number), words, ids, held, tokens)

    def made(batch: int, words: dict, ids: list, held: list, tokens: list) -> pd.DataFrame:
        h, t = np.fromiter(map(_hash, words), np.uint64, len(words)), np.concatenate(tokens)
        order = np.argsort(-np.bincount(t), kind="stable")  # small numbers for frequent words
        place = np.empty(len(h), np.int32)
        place[order] = np.arange(len(h), dtype=np.int32)
        lengths = np.array([len(x) for x in tokens], np.int64)
        t, flags = place[t], np.array(held, np.uint8)
        n = np.bincount(t[np.repeat(flags & 1 == 0, lengths)], minlength=len(h))
        by_hash = np.argsort(h)
        return pd.DataFrame({"batch": [batch], "docs": [pack(np.array(ids, np.int64), flags, lengths)], "tokens": [pack(t, place[by_hash])], "words": [pack(h[by_hash], n[place[by_hash]])], "n": [len(t)], "train_docs": [int((flags & 1 == 0).sum())]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("null"), "text", train.alias("train"))
    return map_batches(rows, run, "batch long, docs binary, tokens binary, words binary, n long, train_docs long")


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of equal numbers."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return ((int(bucket[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True) if b > a)


def unigrams(made: DataFrame, buckets: int) -> DataFrame:
    """Words dealt to buckets by hash: a row a bucket with its words and counts, and a row a batch and bucket with counts and numbers of the batch's words."""

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for batch, data in zip(b["batch"], b["words"], strict=True):
                h, n = unpack(data, np.uint64, np.int64)
                to = ((h >> np.uint64(31)) & np.uint64(0xFFFFFFFF)).astype(np.int64) * buckets >> 32  # grows with the hash
                cut = list(_slices(to))
                yield pd.DataFrame({"bucket": [k for k, _, _ in cut], "batch": batch, "data": [pack(h[x:y], n[x:y]) for _, x, y in cut]})

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x, np.uint64, np.int64) for x in rows["data"]]
        h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
        order = np.lexsort((h, -n))  # a word's place, the most frequent first, makes its number
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        h, n, inverse = h[order], n[order], place[inverse]
        ends = np.cumsum([len(p[0]) for p in parts])
        out = pd.DataFrame({"batch": rows["batch"], "bucket": key[0], "data": [pack(n[i], START + 1 + i * buckets + key[0]) for i in np.split(inverse, ends[:-1])]})
        seen = n > 0
        often = np.flatnonzero(n > MOST)[:HEAD]
        own = {"batch": -1, "bucket": key[0], "data": pack(h[seen], n[seen]), "v": int(seen.sum()), "n": int(n.sum()), "r": [int((n == r).sum()) for r in range(MOST + 2)], "h": h[often].view(np.int64), "c": n[often], "w": START + 1 + often * buckets + key[0]}
        none = [[]] * len(out)
        return pd.concat([out.assign(v=0, n=0, r=none, h=none, c=none, w=none), pd.DataFrame([own])])

    dealt = map_batches(made.select("batch", "words"), deal, "bucket long, batch long, data binary")
    return dealt.groupBy("bucket").applyInPandas(count, "batch long, bucket long, data binary, v long, n long, r array<long>, h array<long>, c array<long>, w array<long>")


def lower_order(words: DataFrame) -> Unigrams:
    own = words.where("batch < 0")
    x = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"), *(F.sum(F.get("r", F.lit(r))).alias(f"r{r}") for r in range(1, MOST + 2))).first()
    top = own.select(F.explode(F.arrays_zip("h", "c", "w")).alias("x")).select("x.h", "x.c", "x.w").orderBy(F.col("c").desc(), "h").limit(HEAD).toPandas()
    return Unigrams(x["n"], x["v"], {r: x[f"r{r}"] or 0 for r in range(1, MOST + 2)}, top["h"].to_numpy(np.int64).view(np.uint64), top["w"].to_numpy(np.int64), top["c"].to_numpy(np.int64))


def _before(t: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return before


def hot_pairs(made: DataFrame, uni: Unigrams) -> dict[int, int]:
    """Counts over MOST of bigrams of the HOT words, by context * HOT + word; the start is context HOT."""
    shared = made.sparkSession.sparkContext.broadcast(uni.hot)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = shared.value
        ranks = np.argsort(hot)
        for b in parts:
            for docs, tokens, words in zip(b["docs"], b["tokens"], b["words"], strict=True):
                _, flags, lengths = unpack(docs, np.int64, np.uint8, np.int64)
                t, place = unpack(tokens, np.int32, np.int32)
                h, _ = unpack(words, np.uint64, np.int64)
                rank = np.full(len(h) + 1, HOT + 1)
                at = np.minimum(np.searchsorted(h, hot[ranks]), len(h) - 1)
                met = h[at] == hot[ranks]
                rank[place[at[met]]] = ranks[met]
                rank[-1] = HOT
                v, w = rank[_before(t, lengths, len(h))], rank[t]
                both = (v <= HOT) & (w < HOT) & np.repeat(flags & 1 == 0, lengths)
                n = np.bincount(v[both] * HOT + w[both], minlength=1)
                k = np.flatnonzero(n)
                yield pd.DataFrame({"k": k, "n": n[k]})

    rows = map_batches(made.select("docs", "tokens", "words"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > MOST).toPandas()
    return dict(zip(rows["k"].tolist(), rows["n"].tolist(), strict=True))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    h = (a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29)) ^ b) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def heavy_codes(uni: Unigrams, heavy: int) -> int:
    """Ranks below it are heavy contexts."""
    return int(max(min(HOT, len(uni.counts)), (uni.counts > heavy).sum()))


def requests(made: DataFrame, words: DataFrame, uni: Unigrams, hot: dict[int, int], starts: int, buckets: int, heavy: int) -> DataFrame:
    """Bigrams dealt to buckets, (bucket, batch, data); a batch's own row has the bucket -1 - batch and what is known of its documents without them."""
    hot_p = np.full((HOT + 1) * HOT, np.nan)
    own = np.append(uni.counts[:HOT], np.zeros(max(0, HOT - len(uni.counts)), np.int64))
    for k, n in hot.items():
        v = k // HOT
        hot_p[k] = math.log10(n / ((starts if v == HOT else int(own[v])) + 0.5))
    shared = made.sparkSession.sparkContext.broadcast((uni, hot_p))
    limit = heavy_codes(uni, heavy)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uni, hot_p = shared.value
        for b in parts:
            for row in b.itertuples():
                yield dealt(row, uni, hot_p)

    def dealt(row: tuple, uni: Unigrams, hot_p: np.ndarray) -> pd.DataFrame:
        ids, flags, lengths = unpack(row.docs, np.int64, np.uint8, np.int64)
        t, place = unpack(row.tokens, np.int32, np.int32)
        c, codes = np.zeros(len(place) + 1, np.int64), np.full(len(place) + 1, START)
        c[place], numbers = (np.concatenate(x) for x in zip(*(unpack(x, np.int64, np.int64) for x in row.counts), strict=True))
        codes[place] = uni.codes(numbers)
        order = np.argsort(codes)  # words by code from here on
        sorted_ = np.empty(len(order), np.int64)
        sorted_[order] = np.arange(len(order))
        codes, c, before, t = codes[order], c[order], sorted_[_before(t, lengths, len(place))], sorted_[t]
        first = np.cumsum(lengths) - lengths
        known, base = np.add.reduceat((c > 0)[t].astype(np.int64), first), np.add.reduceat(uni.base(c)[t], first)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint16), lengths)
        rank = np.where(codes == START, HOT, np.where(codes < HOT, codes, HOT + 1))
        a, b = rank[before], rank[t]
        both = np.flatnonzero((a <= HOT) & (b < HOT))
        p = hot_p[a[both] * HOT + b[both]]
        met = ~np.isnan(p)
        score = np.bincount(doc[both[met]], p[met], len(ids))
        rest = np.ones(len(t), bool)
        rest[both[met]] = False
        v, w, doc = before[rest], t[rest], doc[rest]
        whole = (codes[v] >= limit) & (codes[v] != START)
        to = (_mix(codes[v], np.where(whole, 0, codes[w])) % np.uint64(buckets)).astype(np.int64)
        key = (to << 42) | (v * len(codes) + w)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])[: len(key)]
        times = np.diff(np.append(at, len(key)))
        n = np.add.reduceat((flags[doc] & 1 == 0).astype(np.int64), at) if len(at) else at
        v, w, to = v[order][at], w[order][at], key[at] >> 42
        count = np.where(codes[w] < HEAD, 0, c[w])
        ends = np.append(at, len(key))
        cut = list(_slices(to))
        data = []
        for _, x, y in cut:
            new = np.concatenate([[0], np.flatnonzero(np.diff(v[x:y])) + 1])
            data.append(pack(np.diff(codes[v[x:y][new]], prepend=0), np.diff(np.append(new, y - x)).astype(np.uint32), codes[w[x:y]], count[x:y].astype(np.uint32), n[x:y].astype(np.uint32), times[x:y].astype(np.uint32), doc[ends[x] : ends[y]]))
        own = pack(ids, flags, lengths, known, base, score)
        return pd.DataFrame({"bucket": [k for k, _, _ in cut] + [-1 - row.batch], "batch": row.batch, "data": [*data, own]})

    answers = words.where("batch >= 0").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).getField("data").alias("counts"))
    rows = made.select("batch", "docs", "tokens").join(answers, "batch")
    return map_batches(rows, run, "bucket long, batch long, data binary")


def bigrams(dealt: DataFrame, uni: Unigrams, heavy: int) -> DataFrame:
    """A row a bucket: its bigrams with their counts, the batches' requests as places among them, counts of counts, sums of heavy contexts.

    Batches' own rows pass as they are (part -1)."""
    shared = dealt.sparkSession.sparkContext.broadcast(uni)
    limit = heavy_codes(uni, heavy)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            none = [[]] * len(rows)
            return pd.DataFrame({"part": -1, "bucket": key[0], "batch": rows["batch"], "data": rows["data"], "asked": none, "r": none, "hv": none, "hs": none})
        vs, ws, cs, ns, asked = [], [], [], [], []
        for data in rows["data"]:
            v, runs, w, c, n, times, doc = unpack(data, np.int64, np.uint32, np.int64, np.uint32, np.uint32, np.uint32, np.uint16)
            vs.append(np.repeat(np.cumsum(v), runs))
            ws.append(w)
            cs.append(c)
            ns.append(n)
            asked.append((times, doc))
        v, w = np.concatenate(vs), np.concatenate(ws)
        order = np.lexsort((w, v))
        new = np.ones(len(v), bool)
        new[1:] = (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)
        place = np.empty(len(v), np.int64)
        place[order] = np.cumsum(new) - 1
        n = np.bincount(place, np.concatenate(ns)).astype(np.int64)
        v, w, c = v[order][new], w[order][new], np.concatenate(cs)[order][new].astype(np.int64)
        ends = np.cumsum([len(x) for x in vs])
        data = [pack(np.diff(p, prepend=0).astype(np.uint32), times, doc) for p, (times, doc) in zip(np.split(place, ends[:-1]), asked, strict=True)]
        own = ((v < limit) | (v == START)) & (n > 0)
        p = shared.value.p(counts_of(w[own], c[own], shared.value))
        hv, at = np.unique(v[own], return_inverse=True)
        hn = n[own]
        sums = [np.bincount(at[hn == r], minlength=len(hv)).astype(np.float64) for r in range(1, MOST + 1)]
        sums += [np.bincount(at, np.where(hn > MOST, hn, 0), len(hv)), np.bincount(at, p, len(hv))]
        first = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1])
        model = pack(np.diff(v[first], prepend=0), np.diff(np.append(first, len(v))).astype(np.uint32), w, c, n)
        row = {"part": key[0] % PARTS, "bucket": key[0], "batch": -1, "data": model, "asked": [{"batch": b, "data": d} for b, d in zip(rows["batch"], data, strict=True)], "r": [int((n == r).sum()) for r in range(MOST + 2)], "hv": hv, "hs": [list(x) for x in zip(*sums, strict=True)]}
        return pd.DataFrame([row], columns=NAMES)

    NAMES = ["part", "bucket", "batch", "data", "asked", "r", "hv", "hs"]
    return dealt.groupBy("bucket").applyInPandas(run, "part int, bucket long, batch long, data binary, asked array<struct<batch: long, data: binary>>, r array<long>, hv array<long>, hs array<array<double>>")


def counts_of(w: np.ndarray, c: np.ndarray, uni: Unigrams) -> np.ndarray:
    """Words' counts: those of the head from the model, others' stand beside them."""
    out = c.copy()
    head = w < HEAD
    out[head] = uni.counts[w[head]]
    return out


class Backoff:
    """What scoring needs beside a bucket's bigrams: the lower order, discounts, and counts and alphas of heavy contexts."""

    def __init__(self, uni: Unigrams, d: np.ndarray, heavy: dict[int, tuple[int, float]]) -> None:
        self.uni, self.d, self.heavy = uni, d, heavy

    def log_p(self, ctx: np.ndarray, runs: np.ndarray, w: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of a bucket's bigrams and alpha of its contexts. ctx: differences of contexts; runs: bigrams of each."""
        ctx, runs = np.cumsum(ctx), runs.astype(np.int64)
        first = np.cumsum(runs) - runs
        total = np.add.reduceat(n, first).astype(np.float64)
        low = self.uni.p(counts_of(w, c, self.uni))
        seen = discounted(n, self.d)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = (1 - np.add.reduceat(seen, first) / (total + 0.5)) / (1 - np.add.reduceat(np.where(n > 0, low, 0.0), first))
        alpha[total == 0] = 1.0
        for i in np.flatnonzero(ctx <= START):
            if int(ctx[i]) in self.heavy:
                total[i], alpha[i] = self.heavy[int(ctx[i])]
        p = np.where(n > 0, seen / np.repeat(total + 0.5, runs), np.repeat(alpha, runs) * low)
        return np.log10(p), alpha


def backoff(stored: DataFrame, uni: Unigrams, hot: dict[int, int], starts: int, heavy: int) -> Backoff:
    own = stored.where("part >= 0")
    x = own.agg(*(F.sum(F.get("r", F.lit(r))).alias(f"r{r}") for r in range(1, MOST + 2))).first()
    small = {r: x[f"r{r}"] or 0 for r in range(1, MOST + 2)}
    small[MOST + 1] += sum(n == MOST + 1 for n in hot.values())
    d = discounts(small)
    each = own.select(F.explode(F.arrays_zip("hv", "hs")).alias("x")).select(F.col("x.hv").alias("v"), F.col("x.hs").alias("s"))
    sums = each.groupBy("v").agg(*(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(MOST + 2))).collect()  # HEAD + 1 rows at most
    seen, low = {}, {}
    for s in sums:
        seen[s["v"]] = sum(d[r] * r * s[f"s{r - 1}"] for r in range(1, MOST + 1)) + s[f"s{MOST}"]
        low[s["v"]] = s[f"s{MOST + 1}"]
    p = uni.p(uni.counts)
    for k, n in hot.items():
        v = START if k // HOT == HOT else k // HOT
        seen[v] = seen.get(v, 0.0) + n
        low[v] = low.get(v, 0.0) + p[k % HOT]
    heavies = {v: int(uni.counts[v]) for v in range(heavy_codes(uni, heavy))} | ({START: starts} if starts else {})
    return Backoff(uni, d, {v: (n, (1 - seen.get(v, 0.0) / (n + 0.5)) / (1 - low.get(v, 0.0))) for v, n in heavies.items()})


def sums_of(stored: DataFrame, model: Backoff) -> DataFrame:
    """batch, data: what each bucket adds to the scores of a batch's documents."""
    shared = stored.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for data, asked in zip(b["data"], b["asked"], strict=True):
                p, _ = shared.value.log_p(*unpack(data, np.int64, np.uint32, np.int64, np.int64, np.int64))
                out = []
                for x in asked:
                    place, times, doc = unpack(x["data"], np.uint32, np.uint32, np.uint16)
                    total = np.bincount(doc, np.repeat(p[np.cumsum(place, dtype=np.int64)], times))
                    some = np.unique(doc)
                    out.append((x["batch"], pack(some, total[some])))
                yield pd.DataFrame(out, columns=["batch", "data"])

    return map_batches(stored.where("part >= 0").select("data", "asked"), run, "batch long, data binary")


class Katz:
    """A model fitted to the training rows of docs, and all rows' scores."""

    def __init__(self, spark: SparkSession, docs: DataFrame, train: Column, bucket: int = BUCKET, heavy: int = HEAVY) -> None:
        with batch_rows(spark):
            made = table(spark, batches(docs, train), "batches")
        with batch_rows(spark, 2):  # rows of some megabytes
            size = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("d")).first()
            buckets = max(BUCKETS, -(-size["n"] // bucket))
            words = table(spark, unigrams(made, buckets), "unigrams")
            collect_garbage(spark)  # shuffle files of what is written
            self.words = words.where("batch < 0").select("bucket", "data")
            uni = lower_order(words)
            hot = hot_pairs(made, uni)
            path = scratch_path(spark, "bigrams")
            dealt = bigrams(requests(made, words, uni, hot, size["d"], buckets, heavy), uni, heavy)
            dealt.write.partitionBy("part").option("compression", "uncompressed").parquet(path)
            delete(spark, made.inputFiles()[0].rsplit("/", 1)[0])
            collect_garbage(spark)
            self.bigrams = spark.read.schema(dealt.schema).parquet(path)
            self.model, self.hot = backoff(self.bigrams, uni, hot, size["d"], heavy), hot
            self.sums = table(spark, sums_of(self.bigrams, self.model), "sums")
        collect_garbage(spark)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row."""
        n = self.model.uni.n

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            ids, flags, lengths, known, base, score = unpack(rows.loc[rows["own"], "data"].iloc[0], np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64)
            score = score.copy()
            for data in rows.loc[~rows["own"]].sort_values("data")["data"]:
                some, add = unpack(data, np.uint16, np.float64)
                score[some] += add
            out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": flags & 1 == 1, "n_tokens": lengths, "n_known": known, "train_tokens": n, "base_score": base if n else np.zeros(len(ids)), "score": score})
            out.loc[flags >= 2, "doc_id"] = pd.NA
            return out

        rows = self.bigrams.where("part < 0").select("batch", "data", F.lit(True).alias("own")).unionByName(self.sums.select("batch", "data", F.lit(False).alias("own")))
        return rows.groupBy("batch").applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return Katz(spark, docs, crc_mod(F.col("doc_id"), 5) != 1).scores()
