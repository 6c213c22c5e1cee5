"""Weakly supervised learning: prototypes, blends, hold-out by groups, metrics, forests, novelty and patch shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ship import ship


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def prototypes(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """Per label: the mean vector, of length one."""
    mean = rows.select(label, F.posexplode(vector).alias("p", "v")).groupBy(label, "p").agg(F.avg("v").alias("m"))
    vec = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("m"))
    return vec.select(label, F.transform("m", lambda v: v / F.greatest(norm(F.col("m")), F.lit(1e-9))).alias("prototype"))


def prototype_probability(x: Column, positive: Column, negative: Column) -> Column:
    """Logistic with slope 4 of the difference of cosines, clipped to 2; one half without prototypes."""
    margin = (dot(x, positive) - dot(x, negative)) / F.greatest(norm(x), F.lit(1e-9))
    return F.coalesce(1 / (1 + F.exp(-4 * F.least(F.lit(2.0), F.greatest(F.lit(-2.0), margin)))), F.lit(0.5))


def blend(classifier: Column, prototype: Column) -> Column:
    return 0.68 * classifier + 0.32 * prototype


def holdout(rows: DataFrame, group: str, percent: int = 20) -> DataFrame:
    """held_out: whether a row's group is among the `percent` of groups with the smallest hashes; groups are never split."""
    groups = rows.select(group).distinct().withColumn("_h", F.md5(F.col(group).cast("string")))
    n = groups.count()
    cut = groups.orderBy("_h", group).limit(n * percent // 100).withColumn("_out", F.lit(True)).drop("_h")
    return rows.join(cut, group, "left").withColumn("held_out", F.coalesce("_out", F.lit(False))).drop("_out")


def binary_metrics(rows: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    p, y = F.col(score) >= cut, F.col(label) == 1
    tp, fp, fn, tn = (F.sum(x.cast("double")) for x in (p & y, p & ~y, ~p & y, ~p & ~y))
    precision, recall = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return rows.agg(((tp + tn) / F.count("*")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """By the rank sum with mean ranks for ties: scores are counted first, then ranked by sums over their distinct values."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("b", F.floor(F.col("s") * 64))
    before = by.groupBy("b").agg(F.sum("n").alias("bn")).withColumn("start", F.sum("bn").over(W.orderBy("b")) - F.col("bn"))  # 65 rows at most for scores in 0..1
    run = F.sum("n").over(W.partitionBy("b").orderBy("s"))
    ranked = by.join(F.broadcast(before.select("b", "start")), "b").withColumn("rank", F.col("start") + run - F.col("n") + (F.col("n") + 1) / 2)
    x = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("ranks"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return x.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).otherwise(0.0).alias("auc"))


def balanced(rows: DataFrame, label: str, keys: list[str], positives: int, negatives: int, seed: int = 20261004) -> DataFrame:
    """A bounded sample of both kinds, by hashes of the keys."""
    order = F.xxhash64(F.lit(seed), *keys)
    return rows.where(F.col(label) == 1).orderBy(order, *keys).limit(positives).unionByName(rows.where(F.col(label) == 0).orderBy(order, *keys).limit(negatives))


def forest(train: DataFrame, score: DataFrame, features: list[str], label: str, trees: int = 160, depth: int = 14, leaf: int = 8, seed: int = 42) -> DataFrame:
    """score with likelihood: a random forest, classes weighted to balance."""
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    weight = F.when(F.col(label) == 1, float(n.get(0, 0)) / max(1, n.get(1, 1))).otherwise(1.0)
    assemble = VectorAssembler(inputCols=features, outputCol="_f")
    model = RandomForestClassifier(featuresCol="_f", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed).fit(assemble.transform(train.withColumn("_w", weight)))
    return model.transform(assemble.transform(score)).withColumn("likelihood", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")


def embedding(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """rows with embedding: whitened principal components."""
    x = VectorAssembler(inputCols=features, outputCol="_f").transform(rows)
    x = StandardScaler(inputCol="_f", outputCol="_s", withMean=True, withStd=True).fit(x).transform(x)
    x = PCA(k=k, inputCol="_s", outputCol="_p").fit(x).transform(x)
    return StandardScaler(inputCol="_p", outputCol="embedding", withStd=True).fit(x).transform(x).withColumn("embedding", vector_to_array("embedding")).drop("_f", "_s", "_p")


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    n = len(x)
    spread = x.max(axis=0) - x.min(axis=0) if n else np.zeros(x.shape[1])
    if depth <= 0 or n <= 1 or not spread.any():
        return (n,)
    f = int(rng.choice(np.flatnonzero(spread)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return (f, cut, _tree(x[left], depth - 1, rng), _tree(x[~left], depth - 1, rng))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n points (Liu and others, 2008)."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _paths(node: tuple, x: np.ndarray, depth: int, out: np.ndarray, rows: np.ndarray) -> None:
    if len(node) == 1:
        out[rows] += depth + _expected(node[0])
        return
    left = x[rows, node[0]] < node[1]
    _paths(node[2], x, depth + 1, out, rows[left])
    _paths(node[3], x, depth + 1, out, rows[~left])


def isolation(rows: DataFrame, keys: list[str], features: list[str], trees: int = 100, sample: int = 2048, seed: int = 20261004) -> DataFrame:
    """keys and novelty (0..1, higher: easier to isolate), from an isolation forest on a bounded sample of rows."""
    ship(rows.sparkSession)
    picked = rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(sample).select(*features).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    part = min(256, len(picked))
    forest_ = [_tree(picked[rng.choice(len(picked), part, replace=False)], int(np.ceil(np.log2(max(2, part)))), rng) for _ in range(trees)] if len(picked) else []
    whole = max(_expected(part), 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, out = b[features].to_numpy(float), np.zeros(len(b))
            for t in forest_:
                _paths(t, x, 0, out, np.arange(len(b)))
            yield b[keys].assign(novelty=2.0 ** (-out / max(1, len(forest_)) / whole))

    return rows.select(*keys, *features).mapInPandas(run, rows.select(*keys).schema.add("novelty", "double"))


def radial_profile(patch: DataFrame, side: int, bins: int = 16) -> DataFrame:
    """ring, mean: the patch's means over rings; a corner at the largest radius lies in no ring."""
    mid = (side - 1) / 2
    radius = F.hypot(F.col("r") - mid, F.col("c") - mid) / (mid * 2**0.5)
    return patch.withColumn("ring", F.floor(radius * bins)).where(F.col("ring") < bins).groupBy("ring").agg(F.avg("v").alias("mean"))


def moments(patch: DataFrame) -> DataFrame:
    """Eight numbers about the weighted centre, in cells, with weights |v| + 1e-3: eigenvalues of the second moments (the smaller
    first), trace, determinant, ratio; means of weighted third and fourth powers over the whole weight; the mean weight."""
    w = F.abs("v") + 1e-3
    centre = patch.agg(F.sum(w).alias("w"), (F.sum(w * F.col("r")) / F.sum(w)).alias("my"), (F.sum(w * F.col("c")) / F.sum(w)).alias("mx"))
    d = patch.crossJoin(F.broadcast(centre))
    y, x, whole = F.col("r") - F.col("my"), F.col("c") - F.col("mx"), F.first("w")
    m = d.agg(
        (F.sum(w * x * x) / whole).alias("xx"), (F.sum(w * x * y) / whole).alias("xy"), (F.sum(w * y * y) / whole).alias("yy"),
        (F.avg((x * x * x + y * y * y) * w) / whole).alias("skew"), (F.avg((x * x * x * x + y * y * y * y) * w) / whole).alias("kurtosis"), F.avg(w).alias("weight"),
    )
    trace, det = F.col("xx") + F.col("yy"), F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    root = F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0)))
    minor, major = trace / 2 - root, trace / 2 + root
    return m.select(minor.alias("minor"), major.alias("major"), trace.alias("trace"), det.alias("det"), (major / F.greatest(minor, F.lit(1e-6))).alias("ratio"), "skew", "kurtosis", "weight")


def _patch_descriptor(z: np.ndarray) -> np.ndarray:
    """Elevation, slope and Laplacian of a patch, robustly normalised, on a 32 x 32 grid, flattened."""
    gy, gx = np.gradient(z)
    lap = np.gradient(gx, axis=1) + np.gradient(gy, axis=0)
    out = []
    for ch in (z, np.hypot(gx, gy), lap):
        med = np.median(ch)
        ch = np.clip((ch - med) / max(0.05, 1.4826 * np.median(np.abs(ch - med))), -6, 6)
        at = np.linspace(0, 1, 32)
        iy, ix = at * (ch.shape[0] - 1), at * (ch.shape[1] - 1)
        y0, x0 = np.minimum(iy.astype(int), max(0, ch.shape[0] - 2)), np.minimum(ix.astype(int), max(0, ch.shape[1] - 2))
        y1, x1 = np.minimum(y0 + 1, ch.shape[0] - 1), np.minimum(x0 + 1, ch.shape[1] - 1)
        fy, fx = (iy - y0)[:, None], (ix - x0)[None, :]
        out.append((ch[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + ch[np.ix_(y0, x1)] * (1 - fy) * fx + ch[np.ix_(y1, x0)] * fy * (1 - fx) + ch[np.ix_(y1, x1)] * fy * fx).ravel())
    return np.concatenate(out)


def patch_descriptors(cells: DataFrame, centres: DataFrame, half: int) -> DataFrame:
    """id, descriptor (3072 numbers) of the square patch around each centre (id, r, c); cells outside are 0. A group is one patch."""
    ship(cells.sparkSession)
    off = F.sequence(F.lit(-half), F.lit(half)).cast("array<long>")
    want = centres.withColumn("_dr", F.explode(off)).withColumn("_dc", F.explode(off))
    want = want.select("id", "_dr", "_dc", (F.col("r") + F.col("_dr")).alias("r"), (F.col("c") + F.col("_dc")).alias("c"))
    got = want.join(cells.select("r", "c", "v"), ["r", "c"], "left").select("id", "_dr", "_dc", F.coalesce("v", F.lit(0.0)).alias("v"))
    n = 2 * half + 1

    def one(b: pd.DataFrame) -> pd.DataFrame:
        z = b.sort_values(["_dr", "_dc"])["v"].to_numpy(float).reshape(n, n)
        return pd.DataFrame({"id": [b["id"].iloc[0]], "descriptor": [_patch_descriptor(z)]})

    return got.groupBy("id").applyInPandas(one, "id long, descriptor array<double>")


def examples(features: DataFrame, scale: Column, scales: tuple[float, ...] = (0.75, 1.0, 1.5), rotations: int = 8) -> DataFrame:
    """Positive training examples: each feature (id) at several scales, clamped to 32..256 and distinct, and all rotations."""
    sizes = F.array_distinct(F.array(*(F.least(F.lit(256.0), F.greatest(F.lit(32.0), scale * s)) for s in scales)))
    return features.select("id", F.explode(sizes).alias("scale")).withColumn("rotation", F.explode(F.array(*(F.lit(k * 360.0 / rotations) for k in range(rotations)))))


def negatives(tiles: DataFrame, forbidden: DataFrame, wanted: int, buffer: float, seed: str = "n", tries: int = 30) -> DataFrame:
    """Per tile (id, x0, y0, x1, y1) the first `wanted` of tries * wanted hashed points that keep `buffer` away from forbidden boxes (id, x0, y0, x1, y1)."""
    from .vector import overlapping

    def unit(tag: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed + tag), F.col("id"), F.col("k"))), 1, 8), 16, 10).cast("double") / 4294967296.0

    points = tiles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries * wanted - 1))))
    points = points.select("id", "k", (F.col("x0") + unit("x") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + unit("y") * (F.col("y1") - F.col("y0"))).alias("y"))
    dots = points.select("id", "k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    hit = overlapping(dots, forbidden.select("id", "x0", "y0", "x1", "y1"), max(8.0, 2 * buffer), pad=buffer)
    free = points.join(hit.select(F.col("l_id").alias("id"), F.col("l_k").alias("k")), ["id", "k"], "left_anti")
    return free.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("k"))).where(F.col("_n") <= wanted).drop("_n")
