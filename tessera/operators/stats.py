"""Compositions, histograms, correlations, tag statistics and preferences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranking import WIDTH
from tessera.session import ensure_checkpoints


def first_by_key(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """One row for each key, the first in order (O56): a minimum aggregated on the map side, not a window over whole groups."""
    return df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def composition(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages by value; null is a value."""
    total = df.count()
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("pct", F.lit(100.0) * F.col("n") / F.lit(total))


def auto_bins(n: int, low: float, high: float, iqr: float, integers: bool = False) -> int:
    """The number of equal bins between low and high: by the narrower of the Freedman-Diaconis and Sturges widths."""
    if n == 0 or high == low:
        return 1
    sturges = (high - low) / (math.log2(n) + 1)
    width = min(2 * iqr * n ** (-1 / 3), sturges) if iqr > 0 else sturges
    if integers:
        width = max(width, 1.0)
    return max(1, math.ceil((high - low) / width))


def histogram(df: DataFrame, value: str, by: list[str] | None = None, low: float | None = None, high: float | None = None, bins: int | None = None) -> DataFrame:
    """(by..., bin, n) over equal bins, the last closed; values outside a given range and nulls are left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    rows = rows if low is None else rows.where(v >= low)
    rows = rows if high is None else rows.where(v <= high)
    s = rows.agg(F.count("*").alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).first()
    if not s["n"]:
        return rows.select(*(by or []), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    a, b = (s["a"] if low is None else low), (s["b"] if high is None else high)
    if not bins:
        q1, q3 = quantiles(rows, {value: [0.25, 0.75]})[value]
        bins = auto_bins(s["n"], a, b, q3 - q1)
    k = bins
    bin_ = F.least(F.floor((v - F.lit(float(a))) * k / F.lit(float(b - a or 1))), F.lit(k - 1)).cast("long")
    return rows.groupBy(*(by or []), bin_.alias("bin")).agg(F.count("*").alias("n"))


def _counted(df: DataFrame, value: str, width: int = WIDTH) -> DataFrame:
    """(value, _n, _before) for each different value: how often it occurs and how many rows come before it. Counts are summed in order within
    ranges of about ``width`` different values, which are shifted by the ranges before; no task orders more than one range."""
    ensure_checkpoints(df.sparkSession)
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    parts = max(1, -(-df.agg(F.approx_count_distinct(value)).first()[0] // width))
    counts = counts.repartitionByRange(parts, value).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = counts.groupBy("_range").agg(F.sum("_n").alias("_all")).select("_range", before("_all", W.orderBy("_range")).alias("_shift"))
    own = counts.withColumn("_in", before("_n", W.partitionBy("_range").orderBy(value)))
    return own.join(shift, "_range").select(value, "_n", (F.col("_shift") + F.col("_in")).alias("_before"))


def quantiles(df: DataFrame, columns: dict[str, list[float]], few: int = 100_000, near: float = 2e-4) -> dict[str, list[float | None]]:
    """Exact quantiles of many columns by linear interpolation, nulls and NaN left out: at most three scans, however many columns and shares.

    A sketch of each column gives a bracket for each share: its ranks are off by at most half of ``near``, so the bracket holds the rows asked for. Where a
    bracket has more than ``few`` rows, a second scan counts the rows before it and sketches within it. The last scan counts what lies before each bracket and
    its values; only those counts reach the driver.
    """
    rows = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    accuracy = math.ceil(2 / near)
    asked = [(i, p) for i, shares in enumerate(columns.values()) for p in shares]

    def around(shares: list[float]) -> list[float]:
        return [min(1.0, max(0.0, p + s * near)) for p in shares for s in (-1, 1)]

    first = [f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    first += [F.percentile_approx(f"c{i}", around(shares), accuracy).alias(f"q{i}") for i, shares in enumerate(columns.values()) if shares]
    told = rows.agg(*first).first()
    sizes = [told[f"n{i}"] for i in range(len(columns))]
    brackets: list[tuple[int, int, float, float]] = []  # column, place from 0, low, high
    for i, shares in enumerate(columns.values()):
        for k, p in enumerate(shares if sizes[i] else []):
            small = sizes[i] * near < 4  # a rank more or less would leave the bracket
            low, high = (told[f"a{i}"], told[f"b{i}"]) if small else told[f"q{i}"][2 * k : 2 * k + 2]
            at = p * (sizes[i] - 1)
            brackets += [(i, x, low, high) for x in sorted({math.floor(at), math.ceil(at)})]
    wide = sorted({(i, a, b) for i, _, a, b in brackets if a < b and 2.5 * near * sizes[i] > few})
    if wide:
        grid = [k / 1000 for k in range(1001)]
        inside = lambda i, a, b: (F.col(f"c{i}") >= a) & (F.col(f"c{i}") <= b)
        second = [F.count_if(F.col(f"c{i}") < a).alias(f"b{k}") for k, (i, a, _) in enumerate(wide)]
        second += [F.percentile_approx(F.when(inside(i, a, b), F.col(f"c{i}")), grid, 10_000).alias(f"g{k}") for k, (i, a, b) in enumerate(wide)]
        second += [F.count_if(inside(i, a, b)).alias(f"m{k}") for k, (i, a, b) in enumerate(wide)]
        more = rows.agg(*second).first()
        for k, (i, a, b) in enumerate(wide):
            for j, (c, x, low, high) in enumerate(brackets):
                if (c, low, high) == (i, a, b):
                    place = int((x - more[f"b{k}"]) / max(1, more[f"m{k}"]) * 1000)
                    off = 2 + 3000 // max(1, more[f"m{k}"])
                    brackets[j] = (c, x, more[f"g{k}"][min(1000, max(0, place - off))], more[f"g{k}"][min(1000, max(0, place + off))])
    spans = sorted({(i, a, b) for i, _, a, b in brackets})
    if not spans:
        return {c: [None] * len(shares) for c, shares in columns.items()}
    each = []
    for k, (i, a, b) in enumerate(spans):
        v = F.col(f"c{i}")
        each.append(F.when(v <= b, F.struct(F.lit(k).alias("k"), F.when(v >= a, v).alias("v"))))
    counted = rows.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("n")).collect()
    by_span: dict[int, list] = {}
    for r in counted:
        by_span.setdefault(r["k"], []).append((r["v"] is not None, r["v"] or 0.0, r["n"]))
    ordered = {k: sorted(v) for k, v in by_span.items()}

    def value(i: int, x: int) -> float:
        _, _, a, b = next(t for t in brackets if t[0] == i and t[1] == x)
        before = 0
        for real, v, n in ordered[spans.index((i, a, b))]:
            before += n
            if before > x:
                if not real:
                    break
                return v
        raise ArithmeticError("a sketch was further off than it promises")

    out: dict[str, list[float | None]] = {}
    for i, (c, shares) in enumerate(columns.items()):
        out[c] = []
        for p in shares:
            if not sizes[i]:
                out[c].append(None)
                continue
            at = p * (sizes[i] - 1)
            a, b = value(i, math.floor(at)), value(i, math.ceil(at))
            out[c].append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1 with ties sharing their mean."""
    ranks = _counted(df, value).select(F.col(value).alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return pearson(average_rank(average_rank(both, x, "_rx"), y, "_ry"), "_rx", "_ry")


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_diversity(df: DataFrame, tags: str) -> DataFrame:
    """Distinct tags per row, and rows x distinct / (100 x occurrences)."""
    rows = df.count()
    t = tag_counts(df, tags).agg(F.count("*").alias("d"), F.sum("n").alias("t"))
    return t.select((F.col("d") / F.lit(rows)).alias("unique_per_row"), (F.lit(rows) * F.col("d") / (F.lit(100.0) * F.col("t"))).alias("inverse_frequency"))


def p95(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The 95th percentile of each column by linear interpolation, nulls left out."""
    return {c: told[0] for c, told in quantiles(df, {c: [0.95] for c in columns}).items()}


def overall_preference(norms: dict[str, float], reward: str = "reward", quality: str = "quality", complexity: str = "complexity", edu: Column | None = None) -> Column:
    """0.4 reward + 0.4 quality + 0.2 complexity, each over its 95th percentile; else the educational score (O117)."""
    part = lambda c, w: F.lit(w) * F.col(c).cast("double") / F.lit(float(norms[c]))
    whole = part(reward, 0.4) + part(quality, 0.4) + part(complexity, 0.2)
    return whole if edu is None else F.coalesce(whole, edu)


def win_rate(df: DataFrame, group: str, winner: str) -> DataFrame:
    """Counts by (group, winner) and their share of the group."""
    n = df.groupBy(group, winner).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def run_counters(df: DataFrame, reason: str) -> DataFrame:
    return df.agg(F.count("*").alias("generated"), F.count_if(F.col(reason).isNull()).alias("kept"), F.count_if(F.col(reason).isNotNull()).alias("dropped"))
