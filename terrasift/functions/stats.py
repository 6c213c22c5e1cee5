"""Robust statistics over whole frames, with exact percentiles: one aggregate and a broadcast row, or counts in bins for large frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable


def with_facts(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df with aggregates over all its rows as columns (one row, broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def quantile(col: str | Column, q: float) -> Column:
    """The exact quantile, linearly interpolated."""
    return F.percentile(col, F.lit(q))


#: Rows up to which exact percentiles are one aggregate, which holds all distinct values in one task. Beyond, ranks are closed in on by counts in bins.
EXACT, BINS, FEW = 4_000_000, 4096, 20_000


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], exact: int = EXACT) -> DataFrame:
    """df (a written frame) with the exact quantiles as columns."""
    if df.limit(exact + 1).count() <= exact:
        return with_facts(df, *(quantile(c, q).alias(name) for name, (c, q) in wanted.items()))
    return df.withColumns({name: F.lit(x) for name, x in quantiles(df, wanted).items()})


def quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], few: int = FEW) -> dict[str, float | None]:
    """Exact interpolated quantiles without a task that holds all values: each round counts BINS bins of what is left around each rank."""
    cols = {name: (F.col(c) if isinstance(c, str) else c).cast("double") for name, (c, _) in wanted.items()}
    first = df.agg(*(f(c).alias(f"{k}_{name}") for name, c in cols.items() for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    found: dict[str, tuple[float, float] | None] = {}
    left: dict[str, tuple[float, float, int]] = {}  # lowest and highest value that is left, and how many are below
    ranks = {}
    for name, (_, q) in wanted.items():
        n, lo, hi = (first[f"{k}_{name}"] for k in ("n", "lo", "hi"))
        ranks[name] = q * (n - 1)
        if not n or lo == hi:
            found[name] = (lo, lo) if n else None
        else:
            left[name] = (lo, hi, 0)
    sizes = {name: first[f"n_{name}"] for name in left}
    while left:
        wide = {name: x for name, x in left.items() if sizes[name] > few}
        parts = [F.when(cols[name].between(lo, hi), F.struct(F.lit(name).alias("name"), (F.least(F.floor((cols[name] - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1)) if name in wide else F.lit(0)).alias("bin"), cols[name].alias("v"))) for name, (lo, hi, _) in left.items()]
        each = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")
        if not wide:
            for name, values in ((r["name"], r["v"]) for r in each.groupBy("name").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()):  # few values each
                k = int(ranks[name]) - left[name][2]
                found[name] = (values[k], values[min(k + 1, len(values) - 1)])
            break
        counts = each.where(F.col("name").isin(list(wide))).groupBy("name", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for name in wide:
            rows, below, k = sorted((r["bin"], r["n"], r["lo"], r["hi"]) for r in counts if r["name"] == name), left[name][2], int(ranks[name])
            for i, (_, n, lo, hi) in enumerate(rows):
                if below + n > k:
                    break
                below += n
            if k == below + n - 1 and i + 1 < len(rows):  # the last of its bin: its neighbour is the first of the next
                found[name] = (hi, rows[i + 1][2])
            elif lo == hi:
                found[name] = (lo, lo)
            else:
                left[name], sizes[name] = (lo, hi, below), n
            if name in found:
                del left[name]
    out = {}
    for name, pair in found.items():
        share = ranks[name] - int(ranks[name])
        out[name] = None if pair is None else pair[0] + share * (pair[1] - pair[0])
    return out


def mad_zs(df: DataFrame, cols: dict[str, str], floor: float = 1e-6) -> DataFrame:
    """For each column: absolute deviation from the median in robust standard deviations. Two aggregates for all columns.

    The frame is written first: each aggregate joins it with itself, and a plan of such joins over an unwritten frame
    would double at every step.
    """
    df = with_quantiles(durable(df), {f"_med_{i}": (c, 0.5) for i, c in enumerate(cols)})
    df = df.select("*", *(F.abs(F.col(c) - F.col(f"_med_{i}")).alias(f"_off_{i}") for i, c in enumerate(cols)))
    df = with_quantiles(df, {f"_mad_{i}": (f"_off_{i}", 0.5) for i in range(len(cols))})
    zs = {out: F.col(f"_off_{i}") / F.greatest(F.lit(floor), 1.4826 * F.col(f"_mad_{i}")) for i, out in enumerate(cols.values())}
    return df.withColumns(zs).drop(*(f"_{k}_{i}" for i in range(len(cols)) for k in ("med", "off", "mad")))


def mad_z(df: DataFrame, col: str, out: str) -> DataFrame:
    return mad_zs(df, {col: out})


def robust_units(df: DataFrame, cols: dict[str, str], q: float = 0.995) -> DataFrame:
    """For each column: its mad_z over that one's q-quantile (1 at least), clipped to 0..1. Three aggregates for all columns."""
    zs = {c: f"_z_{i}" for i, c in enumerate(cols)}
    df = with_quantiles(mad_zs(df, zs), {f"_high{z}": (z, q) for z in zs.values()})
    units = {out: F.least(F.lit(1.0), F.col(z) / F.greatest(F.lit(1.0), F.col(f"_high{z}"))) for z, out in zip(zs.values(), cols.values(), strict=True)}
    return df.withColumns(units).drop(*zs.values(), *(f"_high{z}" for z in zs.values()))


def robust_unit(df: DataFrame, col: str, out: str, q: float = 0.995) -> DataFrame:
    return robust_units(df, {col: out}, q)


def normalised(df: DataFrame, col: str, out: str) -> DataFrame:
    """Signed robust z with a floor of 0.05, clipped to -6..6."""
    df = with_facts(df, quantile(col, 0.5).alias("_med"))
    df = with_facts(df, quantile(F.abs(F.col(col) - F.col("_med")), 0.5).alias("_mad"))
    z = (F.col(col) - F.col("_med")) / F.greatest(F.lit(0.05), 1.4826 * F.col("_mad"))
    return df.withColumn(out, F.least(F.lit(6.0), F.greatest(F.lit(-6.0), z))).drop("_med", "_mad")


def tail_mean(df: DataFrame, keys: list[str], col: str, q: float, out: str) -> DataFrame:
    """By keys: the mean of the values from the q-quantile up."""
    cut = df.groupBy(*keys).agg(F.percentile(col, F.lit(q)).alias("_cut"))
    return df.join(cut, keys).groupBy(*keys).agg(F.avg(F.when(F.col(col) >= F.col("_cut"), F.col(col))).alias(out))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
