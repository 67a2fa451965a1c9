"""Predictors, the linear quantizer, and what follows from quantization codes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.windows import along, shifted

RADIUS = 32768

#: Weights of the interpolators over their neighbours, in order of position.  The monotone one (pchip) has a
#: correction term of weight 0, so it is the linear one.
STENCILS = {
    "linear": (("m1", "p1"), (0.5, 0.5)),
    "linear1": (("m3", "m1"), (-0.5, 1.5)),
    "quad_1": (("m1", "p1", "p3"), (3 / 8, 6 / 8, -1 / 8)),
    "quad_2": (("m3", "m1", "p1"), (-1 / 8, 6 / 8, 3 / 8)),
    "quad_3": (("m5", "m3", "m1"), (3 / 8, -10 / 8, 15 / 8)),
    "cubic": (("m3", "m1", "p1", "p3"), (-1 / 16, 9 / 16, 9 / 16, -1 / 16)),
    "cubic_front": (("m1", "p1", "p3", "p5"), (5 / 16, 15 / 16, -5 / 16, 1 / 16)),
    "cubic_front_2": (("m1", "p1", "p2", "p3"), (1 / 4, 6 / 4, -4 / 4, 1 / 4)),
    "cubic_back": (("m5", "m3", "m1", "p1"), (1 / 16, -5 / 16, 15 / 16, 5 / 16)),
    "cubic_back_2": (("m7", "m5", "m3", "m1"), (-5 / 16, 21 / 16, -35 / 16, 35 / 16)),
    "cubic2": (("m3", "m1", "p1", "p3"), (-3 / 40, 23 / 40, 23 / 40, -3 / 40)),
    "ave3": (("m3", "m1", "p1"), (1 / 3, 1 / 3, 1 / 3)),
    "pchip": (("m1", "p1"), (0.5, 0.5)),
}


def interpolate(kind: str, **values: Column) -> Column:
    """An interpolator over neighbours named m7 .. p5 (m: before, p: after, in grid steps)."""
    names, weights = STENCILS[kind]
    out = F.lit(0.0)
    for name, weight in zip(names, weights, strict=True):
        out = out + values[name] * weight
    return out


def quantize(v: Column, pred: Column, eb: float, radius: int = RADIUS) -> Column:
    """struct(code, recon): code 0 is unpredictable and keeps the value; radius is an exact hit.

    The bound is checked again on the float that a decoder will see.
    """
    value, p = v.cast("double"), pred.cast("double")
    diff = value - p
    steps = F.floor((F.floor(F.least(F.abs(diff) / eb, F.lit(4e18))) + 1) / 2)
    signed = F.when(diff < 0, -steps).otherwise(steps)
    recon = (p + 2 * signed * F.lit(eb)).cast("float")
    holds = (steps < radius) & (F.abs(recon.cast("double") - value) <= eb)
    return F.struct(F.when(holds, (signed + radius).cast("int")).otherwise(F.lit(0)).alias("code"), F.when(holds, recon).otherwise(v.cast("float")).alias("recon"))


def dequantize(pred: Column, code: Column, eb: float, radius: int = RADIUS) -> Column:
    return (pred.cast("double") + 2 * (code - radius) * F.lit(eb)).cast("float")


def quantized_1d(cells: DataFrame, eb: float, radius: int = RADIUS) -> DataFrame:
    """(idx, v, pred, code, recon) with the value before as the prediction (0 at the start)."""
    rows = shifted(cells, {"pred": ("v", -1)}).withColumn("pred", F.coalesce("pred", F.lit(0.0).cast("float")))
    return rows.withColumn("q", quantize(F.col("v"), F.col("pred"), eb, radius)).select("idx", "v", "pred", "q.code", "q.recon")


def code_histogram(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code").agg(F.count("*").alias("cnt"))


def entropy(histogram: DataFrame, zero: int = RADIUS) -> DataFrame:
    """Expected bits a value: -log2 p each; under one bit: 1 at the zero bin, 2.5 next to it, 4 elsewhere; code 0 takes 32."""
    rows = histogram.withColumn("total", histogram.agg(F.sum("cnt")).scalar())
    p = F.col("cnt") / F.col("total")
    bit = -F.log2(p)
    near = F.when(F.col("code") == zero, F.lit(1.0)).when(F.abs(F.col("code") - zero) == 1, F.lit(2.5)).otherwise(F.lit(4.0))
    each = F.when(F.col("code") == 0, p * 32).when(bit >= 32, F.lit(0.0)).when(bit < 1, p * near).otherwise(p * bit)
    return rows.agg(F.sum(each).alias("bits"), F.max(F.when(F.col("code") == zero, p)).alias("p0"), F.max("total").alias("total"))


def after_lossless(bits: DataFrame) -> DataFrame:
    """bits with the ratios before and after the lossless stage."""
    p0 = F.coalesce("p0", F.lit(0.0))
    share = F.when(p0 > 0.5, p0 / F.col("bits")).when(p0 > 0, -(p0 * F.log2(p0)) / F.col("bits")).otherwise(F.lit(0.0))
    gain = 1 / ((1 - p0) * share + (1 - share))
    return bits.select("bits", (32 / F.col("bits")).alias("cr"), (32 / (F.col("bits") / gain)).alias("lossless_cr"))


def near_zero_bins(codes: DataFrame, zero: int = RADIUS, reach: int = 5) -> DataFrame:
    return codes.where((F.col("code") != 0) & (F.abs(F.col("code") - zero) <= reach)).groupBy((F.col("code") - zero).alias("bin")).agg(F.count("*").alias("cnt"))


def top_codes(histogram: DataFrame, k: int = 5) -> DataFrame:
    return histogram.orderBy(F.desc("cnt"), "code").limit(k)


def huffman_lengths(histogram: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol; one symbol alone has one bit."""
    import heapq

    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(histogram.items()))]
    lengths = dict.fromkeys(histogram, 1 if len(histogram) == 1 else 0)
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], count, a[2] + b[2]))
        count += 1
    return lengths


def huffman_bits(codes: DataFrame) -> DataFrame:
    """Total bits of a Huffman code of the codes; at most 2 * RADIUS + 1 rows of the histogram come to the driver."""
    histogram = {r["code"]: r["cnt"] for r in code_histogram(codes).collect()}
    lengths = huffman_lengths(histogram)
    bits = sum(n * lengths[s] for s, n in histogram.items())
    return codes.sparkSession.createDataFrame([(len(histogram), sum(histogram.values()), bits)], "symbols int, codes long, bits long")


def lorenzo_1d(cells: DataFrame, order: int = 1) -> DataFrame:
    """(idx, v, pred): first order repeats the value before, second order goes on the line through the last two."""
    near = shifted(cells, {"a": ("v", -1), "b": ("v", -2)}) if order == 2 else shifted(cells, {"a": ("v", -1)})
    a = F.coalesce(F.col("a").cast("double"), F.lit(0.0))
    pred = 2 * a - F.coalesce(F.col("b").cast("double"), F.lit(0.0)) if order == 2 else a
    return near.select("idx", "v", pred.alias("pred"))


def lorenzo_nd(cells: DataFrame, rank: int, order: int = 1) -> DataFrame:
    """(idx, v, pred) from coordinates, cells outside being zero.

    The predictor's error is the product of one difference operator for each axis, so the error is built axis by axis and
    the prediction is the value less it: a window for each axis instead of one neighbour a time.
    """
    rows = cells.withColumn("e", F.col("v").cast("double"))
    for axis in range(rank):
        w = along(axis, rank)
        one = F.coalesce(F.lag("e", 1).over(w), F.lit(0.0))
        if order == 1:
            rows = rows.withColumn("e2", F.col("e") - one)
        else:
            rows = rows.withColumn("e2", F.col("e") - 2 * one + F.coalesce(F.lag("e", 2).over(w), F.lit(0.0)))
        rows = rows.drop("e").withColumnRenamed("e2", "e")
    return rows.select("idx", "v", (F.col("v").cast("double") - F.col("e")).alias("pred"))


#: Expected noise of the Lorenzo predictors in units of the bound, by rank.
LORENZO_NOISE = {1: {1: 0.5, 2: 0.81, 3: 1.22, 4: 1.79}, 2: {1: 1.08, 2: 2.76, 3: 6.8}}


def regression_blocks(cells: DataFrame, dims: Sequence[int], block: int) -> DataFrame:
    """Plane coefficients of each whole block: slope along every axis, and the constant; null where an extent is 1."""
    rank = len(dims)
    v = F.col("v").cast("double")
    local = [F.expr(f"c{i} % {block}") for i in range(rank)]
    keys = [F.expr(f"c{i} div {block}").cast("int").alias(f"b{i}") for i in range(rank)]
    sums = cells.groupBy(*keys).agg(F.count("*").alias("num"), F.sum(v).alias("s"), *[F.sum(local[i] * v).alias(f"s{i}") for i in range(rank)], *[(F.max(local[i]) + 1).alias(f"d{i}") for i in range(rank)])
    n, constant, out = F.col("num"), F.col("s") / F.col("num"), []
    for i in range(rank):
        d = F.col(f"d{i}")
        c = F.when(d > 1, (2 * F.col(f"s{i}") / (d - 1) - F.col("s")) * 6 / (n * (d + 1)))
        out.append(c.alias(f"slope{i}"))
        constant = constant - (d - 1) * c / 2
    return sums.select(*[f"b{i}" for i in range(rank)], *out, constant.alias("constant"))


def predictor_errors(cells: DataFrame, dims: Sequence[int], block: int, eb: float) -> DataFrame:
    """(block, predictor, err): summed absolute error of each predictor over the diagonal of each block."""
    rank = len(dims)
    keys = [f"b{i}" for i in range(rank)]
    rows = cells.withColumns({f"b{i}": F.expr(f"cast(c{i} div {block} as int)") for i in range(rank)})
    one = lorenzo_nd(cells, rank, 1).select("idx", F.col("pred").alias("lorenzo1"))
    two = lorenzo_nd(cells, rank, 2).select("idx", F.col("pred").alias("lorenzo2"))
    plane = regression_blocks(cells, dims, block)
    diagonal = F.lit(True)
    for i in range(1, rank):
        diagonal = diagonal & (F.expr(f"c{i} % {block}") == F.expr(f"c0 % {block}"))
    fit = F.col("constant")
    for i in range(rank):
        fit = fit + F.col(f"slope{i}") * F.expr(f"c{i} % {block}")
    all_ = rows.where(diagonal).join(one, "idx").join(two, "idx").join(plane, keys)
    v = F.col("v").cast("double")
    errors = F.map_from_arrays(
        F.array(F.lit("lorenzo1"), F.lit("lorenzo2"), F.lit("regression")),
        F.array(F.abs(v - F.col("lorenzo1")) + LORENZO_NOISE[1][rank] * eb, F.abs(v - F.col("lorenzo2")) + LORENZO_NOISE[2][rank] * eb, F.abs(v - fit)),
    )
    return all_.select(*keys, F.explode(errors).alias("predictor", "err")).groupBy(*keys, "predictor").agg(F.sum("err").alias("err"))


def best_predictor(errors: DataFrame, rank: int) -> DataFrame:
    keys = [f"b{i}" for i in range(rank)]
    return errors.groupBy(*keys).agg(F.min_by("predictor", F.struct("err", "predictor")).alias("predictor"))


def quantization_intervals(errors: DataFrame, eb: float, share: float = 0.999, most: int = 65536) -> DataFrame:
    """Intervals so that the share of absolute errors fits, a power of two, at least 32; errors: a column err."""
    rows = errors.select(F.least(F.floor((F.col("err") / eb + 1) / 2).cast("long"), F.lit(most - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("cnt"))
    cumulative = rows.withColumn("upto", F.sum("cnt").over(Window.orderBy("bin"))).withColumn("total", rows.agg(F.sum("cnt")).scalar())
    first = cumulative.where(F.col("upto") > F.col("total") * share).agg(F.coalesce(F.min("bin"), F.lit(most - 1)).alias("bin"))
    needed = 2 * (F.col("bin") + 1)
    return first.select("bin", F.greatest(F.lit(32), F.pow(F.lit(2.0), F.ceil(F.log2(needed.cast("double")))).cast("long")).cast("long").alias("intervals"))


def dense_position(cells: DataFrame, width: float) -> DataFrame:
    """The pair of neighbouring bins with the most values: its middle, a guess at the mean."""
    bins = cells.groupBy(F.floor(F.col("v").cast("double") / width).cast("long").alias("bin")).agg(F.count("*").alias("cnt"))
    pairs = bins.alias("a").join(bins.select((F.col("bin") - 1).alias("bin"), F.col("cnt").alias("next")), "bin", "left")
    total = F.col("cnt") + F.coalesce("next", F.lit(0))
    return pairs.orderBy(F.desc(total), "bin").limit(1).select("bin", total.alias("pair_count"), ((F.col("bin") + 1) * width).alias("position"))


def rough_mean(cells: DataFrame, stride: int) -> DataFrame:
    return cells.where(F.col("idx") % stride == 0).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("rough_mean"))


def runs(rows: DataFrame, value: str, order: str = "idx") -> DataFrame:
    """(start, value, length) of the runs of equal values along a dense order."""
    from fieldloom.operators.windows import prefix_sum

    near = shifted(rows.select(F.col(order).alias("idx"), F.col(value).alias("value")), {"before": ("value", -1)})
    marked = near.withColumn("new", F.when(F.col("before").eqNullSafe(F.col("value")), 0).otherwise(1).cast("long"))
    return prefix_sum(marked, "new", "run").groupBy("run").agg(F.min("idx").alias("start"), F.min("value").alias("value"), F.count("*").alias("length")).drop("run")


def interpolation_pass(cells: DataFrame, dims: Sequence[int], level: int, axis: int, sample: int, kind: str = "cubic") -> DataFrame:
    """(idx, v, pred) of one pass of an interpolation level along an axis.

    Earlier axes advance by the level's stride, later ones by twice it, both times the sampling stride; inner points
    along the axis are every sample-th, edge points are always visited.
    """
    s, rank = 1 << (level - 1), len(dims)
    keep = F.col(f"c{axis}") % s == 0
    for other in range(rank):
        if other != axis:
            keep = keep & (F.col(f"c{other}") % ((s if other < axis else 2 * s) * sample) == 0)
    n = (dims[axis] - 1) // s + 1
    if n <= 1:
        return cells.where("false").select("idx", "v", F.lit(0.0).alias("pred"))
    w = along(axis, rank)
    rows = cells.where(keep).withColumn("i", F.expr(f"cast(c{axis} div {s} as int)"))
    rows = rows.withColumns({**{f"m{k}": F.lag("v", k).over(w).cast("double") for k in (1, 3, 5)}, **{f"p{k}": F.lead("v", k).over(w).cast("double") for k in (1, 3)}})
    at = {k: F.col(k) for k in ("m1", "m3", "m5", "p1", "p3")}
    i = F.col("i")
    if kind == "linear" or n < 5:
        inner = (i + 1 < n) & ((i - 1) % (2 * sample) == 0)
        pred = F.when(inner, interpolate("linear", **at))
        if n % 2 == 0:
            pred = pred.when(i == n - 1, at["m1"] if n < 4 else interpolate("linear1", **at))
    else:
        inner = (i >= 3) & (i + 3 < n) & ((i - 3) % (2 * sample) == 0)
        tail = n - 3 if n % 2 == 0 else n - 2
        pred = F.when(inner, interpolate("cubic", **at)).when(i == 1, interpolate("quad_1", **at)).when(i == tail, interpolate("quad_2", **at))
        if n % 2 == 0:
            pred = pred.when(i == n - 1, interpolate("quad_3", **at))
    return rows.where(i % 2 == 1).withColumn("pred", pred).where("pred is not null").select("idx", "v", "pred")


def interpolate_cross(kind: str, along_axes: Sequence[dict[str, Column]]) -> Column:
    """The mean of an interpolator over several axes through a point."""
    out = F.lit(0.0)
    for values in along_axes:
        out = out + interpolate(kind, **values)
    return out / len(along_axes)


def akima(m3: Column, m1: Column, p1: Column, p3: Column) -> Column:
    """Midpoint of the Akima spline through four points: the mean, corrected by slopes weighted towards the smaller change."""
    left, middle, right = m1 - m3, p1 - m1, p3 - p1
    a, b = F.abs(middle - left), F.abs(right - middle)
    at_left = F.when(a + b == 0, (left + middle) / 2).otherwise((b * left + a * middle) / (a + b))
    at_right = F.when(a + b == 0, (middle + right) / 2).otherwise((b * middle + a * right) / (a + b))
    return (m1 + p1) / 2 + (at_left - at_right) / 8


def polynomial_terms(rank: int) -> list[tuple[int, ...]]:
    """Exponents of the terms up to the second degree: constant, linear, then products."""
    import itertools

    return sorted((e for e in itertools.product(range(3), repeat=rank) if sum(e) <= 2), key=lambda e: (sum(e), e))


def quadratic_blocks(cells: DataFrame, dims: Sequence[int], block: int) -> DataFrame:
    """Least-squares coefficients of each block over the terms up to the second degree, one row a term.

    The sums of products are an ordinary aggregate; only they reach Python, (terms + 1) * terms / 2 numbers a block.
    """
    rank = len(dims)
    terms = polynomial_terms(rank)
    local = [F.expr(f"cast(c{i} % {block} as double)") for i in range(rank)]

    def value(e: tuple[int, ...]) -> Column:
        out = F.lit(1.0)
        for x, power in zip(local, e, strict=True):
            for _ in range(power):
                out = out * x
        return out

    keys = [f"b{i}" for i in range(rank)]
    rows = cells.select(*[F.expr(f"cast(c{i} div {block} as int)").alias(f"b{i}") for i in range(rank)], F.col("v").cast("double").alias("v"), *[value(e).alias(f"t{n}") for n, e in enumerate(terms)])
    count = len(terms)
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"a{i}_{j}") for i in range(count) for j in range(i, count)], *[F.sum(F.col(f"t{i}") * F.col("v")).alias(f"y{i}") for i in range(count)])

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(count)] for i in range(count)])
                c = np.linalg.lstsq(a, np.array([row[f"y{i}"] for i in range(count)]), rcond=None)[0]
                out += [(*(row[k] for k in keys), n, float(c[n])) for n in range(count)]
            yield pd.DataFrame(out, columns=[*keys, "term", "coefficient"])

    return sums.mapInPandas(run, ", ".join([*(f"{k} int" for k in keys), "term int", "coefficient double"]))
