"""Goal-driven choice of a codec and a bound: estimates, searches, and compression into chunks."""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.metadata import GOALS, REGISTERED, chunk_header, read_chunk_header
from fieldloom.operators import stats
from fieldloom.operators.codecs import codec, multilevel
from fieldloom.operators.ssim import mean_ssim
from fieldloom.operators.surrogates import cuszp, sampled, sz3, szp, szx
from fieldloom.sources.fixtures import Field, coords

#: Estimators by codec; an estimator is f(field, eb, ...) -> one row (value).
SURROGATES: dict[str, dict[str, Callable]] = {}


def register_surrogate(name: str, **metrics: Callable) -> None:
    SURROGATES[name] = metrics


for _name, _module in (("sz3", sz3), ("szx", szx), ("szp", szp), ("cuszp", cuszp)):
    register_surrogate(_name, cr=_module.cr, psnr=_module.psnr, ssim=_module.ssim)
register_surrogate("zfp", cr=sampled.zfp_cr, psnr=sampled.zfp_psnr, ssim=sampled.zfp_ssim)
register_surrogate("sperr", cr=sampled.sperr_cr, psnr=sampled.sperr_psnr, ssim=sampled.sperr_ssim)

#: Estimators of many bounds in one plan, by codec and metric.
BOUNDS_AT_ONCE: dict[tuple[str, str], Callable] = {(name, metric): getattr(module, f"{metric}s") for name, module in (("szx", szx), ("szp", szp), ("cuszp", cuszp)) for metric in ("cr", "psnr")}

#: Fixed value: the order in which codecs are tried; the first of equals wins.
ORDER = ("sz3", "zfp", "szx", "sperr", "szp", "cuszp")
DEFAULT = ("sz3", "zfp", "szx", "sperr")


def estimate(field: Field, name: str, eb: float, metric: str, **options) -> DataFrame:
    """(field, codec, eb, metric, value)."""
    if name not in SURROGATES:
        raise ValueError(f"no estimator for {name}")
    value = SURROGATES[name][metric](field, max(eb, 1e-16), **options)
    return value.select(F.lit(field.name).alias("field"), F.lit(name).alias("codec"), F.lit(float(eb)).alias("eb"), F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))


def estimate_all(field: Field, name: str, bounds: Sequence[float], metric: str, **options) -> DataFrame:
    """(field, codec, eb, metric, value) of many bounds: in one plan that reads the field once, where the estimator is an expression."""
    of_many = BOUNDS_AT_ONCE.get((name, metric))
    if of_many is None:
        return reduce(DataFrame.unionByName, [estimate(field, name, eb, metric, **options) for eb in bounds])
    tried = [max(float(eb), 1e-16) for eb in bounds]
    asked = F.element_at(F.array(*[F.lit(float(eb)) for eb in bounds]), F.col("at") + 1)
    found = of_many(field, tried, **options)
    return found.select(F.lit(field.name).alias("field"), F.lit(name).alias("codec"), asked.alias("eb"), F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))


def estimates(field: Field, codecs, eb: float, metric: str, options: dict | None = None) -> DataFrame:
    """The estimates of all codecs as one job."""
    return reduce(DataFrame.unionByName, [estimate(field, c, eb, metric, **(options or {}).get(c, {})) for c in codecs])


def sweep(field: Field, codecs, bounds, metric: str, options: dict | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [estimate_all(field, c, bounds, metric, **(options or {}).get(c, {})) for c in codecs])


def best(rows: DataFrame, largest: bool = True, by: str = "value") -> DataFrame:
    """The best codec's row; the first in ORDER of equals."""
    rank = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("codec")).cast("int")
    key = F.struct((F.col(by) if largest else -F.col(by)).alias("a"), (-rank).alias("b"))
    return rows.where(~F.isnan(by)).groupBy("field").agg(F.max_by(F.struct("codec", "eb", "metric", "value"), key).alias("w")).select("field", "w.*")


def measure(field: Field, name: str, eb: float, metric: str) -> float:
    """What a codec really gets: 'cr', 'psnr' or 'ssim' over the field's chunks."""
    chunks = compress(field, name, eb).persist()
    try:
        if metric == "cr":
            return field.n * 4 / chunks.agg(F.sum("payload_bytes")).first()[0]
        pairs = stats.zipped(field.cells, decompress(chunks))
        if metric == "psnr":
            return pairs.agg(stats.psnr_of(stats.mse(), F.lit(field.range))).first()[0]
        return mean_ssim(coords(pairs, field.dims), field.dims).first()["ssim"]
    finally:
        chunks.unpersist()


AHEAD = 4  # levels of a bisection that are asked in one job


def bisection(target: float, rising: bool, largest: float, low: float = -16.0, tolerance: float = 0.1, ahead: int = 1):
    """Bisection of log10(bound) as a generator: it yields lists of bounds, takes their values, and returns the probes (bound, value).

    A list holds the middles of the next ``ahead`` levels, whichever way they turn out; the probes are those of ahead=1.
    """
    if largest <= 0:
        return []
    high, probes, known = math.log10(largest), [], {}

    def middles(a: float, b: float, levels: int) -> list[float]:
        middle = (a + b) / 2
        return [] if not levels or b - a <= tolerance else [middle, *middles(a, middle, levels - 1), *middles(middle, b, levels - 1)]

    while high - low > tolerance:
        middle = (low + high) / 2
        if middle not in known:
            asked = middles(low, high, ahead)
            known.update(zip(asked, (yield [10**m for m in asked]), strict=True))
        probes.append((10**middle, known[middle]))
        if (known[middle] < target) if rising else (known[middle] > target):
            low = middle
        else:
            high = middle
    return probes


def bisect_all(running: list, ask_all: Callable[[list[float]], list[float]]) -> list[list[tuple[float, float]]]:
    """The probes of several bisections that go on together: one call for what all of them ask next."""
    out: list = [None] * len(running)
    answers: dict[int, list[float] | None] = dict.fromkeys(range(len(running)))
    while answers:
        asked = {}
        for i, answer in answers.items():
            try:
                asked[i] = running[i].send(answer)
            except StopIteration as end:
                out[i] = end.value
        bounds = sorted({eb for own in asked.values() for eb in own})
        value = dict(zip(bounds, ask_all(bounds) if bounds else [], strict=True))
        answers = {i: [value[eb] for eb in own] for i, own in asked.items()}
    return out


def search(ask: Callable[[float], float], target: float, rising: bool, largest: float, low: float = -16.0, tolerance: float = 0.1, ask_all: Callable[[list[float]], list[float]] | None = None) -> list[tuple[float, float]]:
    """The probes (bound, value) of a bisection of log10(bound) in order; the last is the answer.

    rising: whether the value grows with the bound.  An empty bracket gives no probe.  ask_all: values of many bounds.
    """
    own = bisection(target, rising, largest, low, tolerance, AHEAD if ask_all else 1)
    return bisect_all([own], ask_all or (lambda bounds: [ask(eb) for eb in bounds]))[0]


def asker(field: Field, name: str, metric: str, options: dict) -> tuple[Callable[[float], float], Callable[[list[float]], list[float]] | None]:
    """Functions that give the estimates of one bound, and of many in one job where the codec has that."""

    def ask(eb: float) -> float:
        return estimate(field, name, eb, metric, **options).first()["value"]

    def ask_all(bounds: list[float]) -> list[float]:
        found = {r["eb"]: r["value"] for r in estimate_all(field, name, bounds, metric, **options).collect()}  # a row a bound
        return [found[eb] for eb in bounds]

    return ask, ask_all if (name, metric) in BOUNDS_AT_ONCE else None


def find_bounds(field: Field, name: str, metric: str, targets: Sequence[float], options: dict | None = None, **bracket) -> list[list[tuple[float, float]]]:
    """Probes for the bounds at which a codec's estimate meets each target; bracket: largest, low and tolerance of bisection()."""
    ask, ask_all = asker(field, name, metric, (options or {}).get(name, {}))
    largest = bracket.pop("largest", None) or field.range
    running = [bisection(t, metric == "cr", largest, ahead=AHEAD if ask_all else 1, **bracket) for t in targets]
    return bisect_all(running, ask_all or (lambda bounds: [ask(eb) for eb in bounds]))


def find_bound(field: Field, name: str, metric: str, target: float, options: dict | None = None, **bracket) -> list[tuple[float, float]]:
    """Probes for the bound at which a codec's estimate meets the target."""
    return find_bounds(field, name, metric, [target], options, **bracket)[0]


def choose(field: Field, goal: str, target: float, codecs=DEFAULT, options: dict | None = None, prefer: str = "small", bracket: dict | None = None) -> DataFrame:
    """The codec and bound for a goal 'fixed_improved': one row (field, codec, eb, metric, value).

    eb_*: the bound is given.  psnr_cr, ssim_cr, cr_psnr, cr_ssim: every codec's bound is searched, then the improved
    metric decides.  cr_eb: the smallest bound wins, or the largest with prefer='large'.
    """
    if goal not in {GOALS[m] for m in REGISTERED}:
        raise ValueError(f"no goal named {goal}")
    fixed, improved = goal.split("_")
    kept = field.keep()
    if fixed == "eb":
        return best(estimates(kept, codecs, target, improved, options))
    bounds = {}
    for name in codecs:
        probes = find_bound(kept, name, fixed, target, options, **(bracket or {}))
        if probes:
            bounds[name] = probes[-1][0]
    if improved == "eb":
        rows = kept.cells.sparkSession.createDataFrame([(field.name, c, eb, "eb", eb) for c, eb in bounds.items()], "field string, codec string, eb double, metric string, value double")
        return best(rows, largest=prefer == "large")
    return best(reduce(DataFrame.unionByName, [estimate(kept, c, eb, improved, **(options or {}).get(c, {})) for c, eb in bounds.items()]))


def autotune(field: Field, name: str, metric: str, target: float, tolerance: float, most: int = 100, options: dict | None = None) -> tuple[float, float]:
    """The bound in (0, range] whose estimate comes within tolerance (relative) of the target, or the nearest tried.

    A coarse grid over the decades first, then golden sections around its best point.
    """
    (ask, ask_all), tried = asker(field, name, metric, (options or {}).get(name, {})), {}

    def off(log: float) -> float:
        if log not in tried:
            tried[log] = ask(10**log)
        return abs(tried[log] - target)

    top = math.log10(field.range)
    grid = [top - 8 * i / 12 for i in range(13)]
    if ask_all:
        tried.update(zip(grid, ask_all([10**g for g in grid]), strict=True))
    centre = min(grid, key=off)
    low, high = centre - 8 / 12, min(top, centre + 8 / 12)
    ratio = (math.sqrt(5) - 1) / 2
    while len(tried) < most and high - low > 1e-3 and min(map(off, tried)) > tolerance * abs(target):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if off(a) < off(b) else (a, high)
    log = min(tried, key=off)
    return 10**log, tried[log]


CHUNK_ROWS = 64


def as_floats(cells: np.ndarray, eb: float) -> tuple[np.ndarray, float]:
    """(cells as 32-bit floats, what the rounding leaves of the bound); an error where it leaves nothing."""
    values = cells.astype("<f4")
    if cells.dtype == values.dtype:
        return values, eb
    exact = [c == v for c, v in zip(cells.tolist(), values.tolist(), strict=True)]
    if all(exact):
        return values, eb
    wide = np.array([float(abs(c - type(c)(v))) if np.isfinite(v) else 0.0 if c != c or c == v else np.inf for c, v in zip(cells.tolist(), values.tolist(), strict=True)])
    if wide.max() >= eb:
        raise ValueError(f"32-bit floats round cells by {wide.max()}, which a bound of {eb} doesn't allow")
    return values, float(np.nextafter(eb - wide.max(), 0))


def chunk_shape(dims: tuple[int, ...], cells: int = 1 << 16) -> tuple[int, ...]:
    """Chunks are slabs: whole inner axes, and as many of the slowest as fit."""
    inner = math.prod(dims[1:])
    return (max(1, min(dims[0], cells // max(1, inner))), *dims[1:])


CHUNKS = "field string, chunk_id long, codec string, eb double, method_id int, dtype string, dims array<long>, start long, payload binary, payload_bytes long"


def compress(field: Field, name: str | Sequence[str], eb: float | Sequence[float], method: int = 3, cells: int = 1 << 16, options: dict | None = None) -> DataFrame:
    """Self-describing chunks of a field, by one codec or by each of several, under one bound or each of several.

    A chunk's cells meet in one task; its size is bounded by ``cells``.  options go to the codec's encode().
    """
    names, bounds = [name] if isinstance(name, str) else list(name), list(eb) if isinstance(eb, Sequence) else [eb]
    shape = chunk_shape(field.dims, cells)
    size = math.prod(shape)
    label, dims, dtype = field.name, field.dims, field.dtype

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        cells = table.sort_by("idx").column("v").to_numpy()
        values = [as_floats(cells, eb) for eb in bounds]
        own = (len(cells) // math.prod(dims[1:]), *dims[1:])
        rows = []
        for used, (eb, (floats, bound)) in itertools.product(names, zip(bounds, values, strict=True)):
            payload = codec(used).encode(floats.reshape(own), bound, **(options or {}))
            data = chunk_header(len(payload), method, eb) + payload
            rows.append({"field": label, "chunk_id": chunk, "codec": used, "eb": eb, "method_id": method, "dtype": dtype, "dims": [int(d) for d in own], "start": chunk * size, "payload": data, "payload_bytes": len(data)})
        kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64()]
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], kinds, strict=True)})

    return field.cells.withColumn("chunk_id", F.expr(f"idx div {size}")).groupBy("chunk_id").applyInArrow(run, CHUNKS)


def decompress(chunks: DataFrame, with_codec: bool = False) -> DataFrame:
    """(idx, v) of chunks, and the codec if asked for.

    Chunks are grouped by their start and codec, so that a Python process holds one at a time, not all that a batch of rows has.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for name, start, data in zip(*table.columns, strict=True):
            size, _, _ = read_chunk_header(data.as_py())
            head = struct.calcsize("<Qid")
            values = codec(name.as_py()).decode(data.as_py()[head : head + size]).ravel()
            first = start.as_py()
            parts.append(pa.table({"idx": np.arange(first, first + len(values)), "v": values.astype("<f4"), "codec": pa.repeat(name, len(values))}))
        return pa.concat_tables(parts)

    cells = chunks.select("codec", "start", "payload").groupBy("start", "codec").applyInArrow(run, "idx long, v float, codec string")
    return cells if with_codec else cells.select("idx", "v")


def decompress_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """(idx, v) of the cells from first up to last; only chunks that hold some of them are decoded."""
    size = F.aggregate("dims", F.lit(1).cast("long"), lambda a, d: a * d)
    return decompress(chunks.where((F.col("start") < last) & (F.col("start") + size > first))).where((F.col("idx") >= first) & (F.col("idx") < last))


def chunk_table(chunks: DataFrame) -> DataFrame:
    """(field, codec, chunk_id, start, cells, offset, bytes, eb, method_id): the header of a stream of chunks, read from theirs.

    offset: bytes of the chunks before; chunks are summed up by field and codec, which have a row for 65,536 cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_chunk_header(x.as_py()) for x in batch.column(4)]
            cells = [math.prod(x.as_py()) for x in batch.column(5)]
            sizes = [h[0] + struct.calcsize("<Qid") for h in heads]
            columns = [*batch.columns[:4], pa.array(cells, pa.int64()), pa.array(sizes, pa.int64()), pa.array([h[2] for h in heads], pa.float64()), pa.array([h[1] for h in heads], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["field", "codec", "chunk_id", "start", "cells", "bytes", "eb", "method_id"])

    read = chunks.select("field", "codec", "chunk_id", "start", "payload", "dims").mapInArrow(run, "field string, codec string, chunk_id long, start long, cells long, bytes long, eb double, method_id int")
    before = Window.partitionBy("field", "codec").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


def real_ratios(field: Field, name: str, bounds: Sequence[float]) -> DataFrame:
    """(eb, ratio) that a codec really reaches under each bound, in one job."""
    made = compress(field, name, [float(eb) for eb in bounds])
    return made.groupBy("eb").agg((F.lit(field.n * 4) / F.sum("payload_bytes")).alias("ratio"))


#: What levels can be tuned for.
TUNING_TARGETS = ("TUNING_TARGET_RD", "TUNING_TARGET_CR", "TUNING_TARGET_SSIM", "TUNING_TARGET_AC")
LEVELS = tuple((a, b, linear) for linear in (False, True) for a, b in ((1.0, 1.0), (1.25, 2.0), (1.5, 3.0), (2.0, 4.0)))


def tuning_value(target: str) -> Column:
    """How well levels of tried_levels() do, the smaller the better."""
    if target not in TUNING_TARGETS:
        raise ValueError(f"{target} is none of {', '.join(TUNING_TARGETS)}")
    return {"CR": F.col("bits"), "RD": F.col("bits") + F.log2(F.greatest("rmse", F.lit(1e-300))), "SSIM": 1 - F.col("ssim"), "AC": F.col("autocorrelation")}[target.rsplit("_", 1)[1]]


def tried_levels(field: Field, eb: float, every: int, cells: int) -> DataFrame:
    """(n, level, bits, rmse, ssim, autocorrelation) of the interpolation codec with each of LEVELS on every every-th chunk."""
    size = math.prod(chunk_shape(field.dims, cells))
    dims = field.dims

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = table.sort_by("idx").column("v").to_numpy().astype("<f4")
        x = x.reshape(len(x) // math.prod(dims[1:]), *dims[1:])
        wide, rows = x.astype(float).ravel(), []
        c1, c2 = (0.01 * (np.ptp(wide) or 1.0)) ** 2, (0.03 * (np.ptp(wide) or 1.0)) ** 2
        for n, (alpha, beta, linear) in enumerate(LEVELS):
            data, back = multilevel.encode_and_decode(x, eb, alpha, beta, linear)
            y = back.astype(float).ravel()
            e = y - wide
            like = (2 * wide.mean() * y.mean() + c1) * (2 * np.mean((wide - wide.mean()) * (y - y.mean())) + c2) / ((wide.mean() ** 2 + y.mean() ** 2 + c1) * (wide.var() + y.var() + c2))
            rows.append((n, len(wide), 8 * len(data), float((e * e).sum()), float(like), float((e[1:] * e[:-1]).sum())))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("n", "cells", "bits", "sse", "ssim", "lagged"), zip(*rows, strict=True), kinds, strict=True)})

    chosen = field.cells.withColumn("chunk_id", F.expr(f"idx div {size}")).where(F.col("chunk_id") % every == 0)
    tried = chosen.groupBy("chunk_id").applyInArrow(run, "n int, cells long, bits long, sse double, ssim double, lagged double")
    tried = tried.groupBy("n").agg((F.sum("bits") / F.sum("cells")).alias("bits"), F.sqrt(F.sum("sse") / F.sum("cells")).alias("rmse"), F.avg("ssim").alias("ssim"), F.coalesce(F.abs(F.sum("lagged")) / F.nullif(F.sum("sse"), F.lit(0.0)), F.lit(0.0)).alias("autocorrelation"))
    level = F.element_at(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(x).alias("linear")) for a, b, x in LEVELS]), F.col("n") + 1)
    return tried.withColumn("level", level)


def tune_levels(field: Field, eb: float, target: str = "TUNING_TARGET_RD", every: int = 5, cells: int = 1 << 12) -> DataFrame:
    """(alpha, beta, linear, bits, rmse, ssim, autocorrelation, value), best first: levels of the interpolation codec, tried on a sample.

    Every every-th chunk is coded with each choice.  value is the smaller the better: bits a cell for CR, bits and the
    logarithm of the error for RD, one less the similarity for SSIM, the errors' lag-one correlation for AC.
    """
    value = tuning_value(target)
    return tried_levels(field, eb, every, cells).withColumn("value", value).orderBy("value", "n").select("level.*", "bits", "rmse", "ssim", "autocorrelation", "value")


def best_levels(field: Field, eb: float, targets: Sequence[str] = TUNING_TARGETS, every: int = 5, cells: int = 1 << 12) -> DataFrame:
    """(target, alpha, beta, linear): for each target the first row of tune_levels(), from one trial for all of them."""
    asked = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), tuning_value(t).alias("value")) for t in targets]))
    tried = tried_levels(field, eb, every, cells).select("n", "level", asked.alias("asked"))
    best = F.min_by("level", F.struct("asked.value", "n")).alias("level")
    return tried.groupBy(F.col("asked.target").alias("target")).agg(best).select("target", "level.*")


def compress_field(field: Field, goal: str, target: float, codecs=DEFAULT, options: dict | None = None) -> DataFrame:
    """Choose for the goal, then compress: at most one row comes to the driver in between."""
    for name in codecs:
        codec(name)  # one that can only be estimated is an error here
    row = choose(field, goal, target, codecs, options).first()
    return compress(field, row["codec"], row["eb"], {v: k for k, v in GOALS.items()}[goal])
