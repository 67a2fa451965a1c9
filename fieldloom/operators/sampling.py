"""Block samples of a field, as filters on positions; positions of a sample are dense again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.fixtures import idx_of


def sample_blocks(cells: DataFrame, dims: Sequence[int], block: int, stride: int) -> tuple[DataFrame, tuple[int, ...]]:
    """Every stride-th whole block along each axis, moved together; (idx, v, source_idx) and the sample's extents.

    cells: with coordinates.  A block below the number of whole blocks is kept if its number divides by stride.
    """
    keep = F.lit(True)
    new: list[Column] = []
    out: list[int] = []
    for axis, size in enumerate(dims):
        whole = size // block
        b = F.expr(f"c{axis} div {block}")
        keep = keep & (b < whole) & (b % stride == 0)
        new.append(F.expr(f"(c{axis} div {block}) div {stride} * {block} + c{axis} % {block}"))
        out.append(-(-whole // stride) * block)
    return cells.where(keep).select(idx_of(tuple(out), *new).alias("idx"), "v", F.col("idx").alias("source_idx")), tuple(out)


def sample_szx(cells: DataFrame, n: int, rate: int, block: int = 128) -> tuple[DataFrame, int]:
    """A block at the start of every rate * block cells: (block_id, pos, v), and the number of blocks."""
    step = rate * block
    blocks = n // step
    rows = cells.where((F.expr(f"idx div {step}") < blocks) & (F.expr(f"idx % {step}") < block))
    return rows.select(F.expr(f"idx div {step}").alias("block_id"), F.expr(f"cast(idx % {step} as int)").alias("pos"), "v"), blocks


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def zfp_counts(dims: Sequence[int], ratio: float) -> list[tuple[int, int]]:
    """(whole 4-blocks, how many of them are sampled) of each axis."""
    return [(size // 4, max(1, math.floor(ratio ** (1 / len(dims)) * (size // 4)))) for size in dims]


def zfp_place(block: Column, blocks: int, k: int) -> tuple[Column, Column]:
    """(whether a 4-block is one of the k sampled ones, its number among them); they are spread evenly from the first to the last.

    Arithmetic on the block's number, as an axis can have any number of sampled blocks.  The spacing is 1 at least, so the
    only one that can start at a block is the nearest.
    """
    if k == 1:
        return block == 0, F.lit(0).cast("long")
    place = F.floor(block * (k - 1) / (blocks - 1) + 0.5)
    return (block < blocks) & (F.floor(place / (k - 1) * (blocks - 1) + 0.5) == block), place


def sample_zfp(cells: DataFrame, dims: Sequence[int], ratio: float = 0.2) -> tuple[DataFrame, tuple[int, ...]]:
    """(idx, v, source_idx) of the cells in sampled 4-blocks; in one dimension unfilled places of the sample hold 0.

    Membership is arithmetic, without a list of starts.
    """
    if len(dims) == 1:
        n = dims[0]
        m = int(math.floor(n * ratio)) // 4 * 4
        blocks, total = m // 4, n // 4
        step = max(1, _half_up(total / blocks)) * 4 if blocks else n
        at, pos = F.expr(f"idx div {step}"), F.expr(f"idx % {step}")
        hit = cells.where((at < blocks) & (pos < 4) & (at * step + 4 < n)).select((at * 4 + pos).alias("idx"), "v", F.col("idx").alias("source_idx"))
        filled = min(blocks, max(0, -(-(n - 4) // step))) if blocks else 0
        rest = cells.sparkSession.range(filled * 4, m).select(F.col("id").alias("idx"), F.lit(0.0).cast("float").alias("v"), F.lit(None).cast("long").alias("source_idx"))
        return hit.unionByName(rest), (m,)
    new, keep, out = [], F.lit(True), []
    for axis, (blocks, k) in enumerate(zfp_counts(dims, ratio)):
        hit, place = zfp_place(F.expr(f"c{axis} div 4"), blocks, k)
        keep = keep & hit
        new.append(place * 4 + F.expr(f"c{axis} % 4"))
        out.append(4 * k)
    return cells.where(keep).select(idx_of(tuple(out), *new).alias("idx"), "v", F.col("idx").alias("source_idx")), tuple(out)


def sperr_axis_starts(size: int, block: int) -> list[int]:
    return list(range(0, max(0, size - block), block))


def sperr_blocks(dims: Sequence[int], block: int) -> int:
    return math.prod(len(sperr_axis_starts(d, block)) for d in dims)


def sperr_members(cells: DataFrame, dims: Sequence[int], block: int) -> DataFrame:
    """(block_id, pos, v) of all overlapping (block + 1)^d blocks; an edge cell belongs to each block that it bounds."""
    counts = [len(sperr_axis_starts(d, block)) for d in dims]
    rows = cells
    for axis, count in enumerate(counts):
        b = F.expr(f"cast(c{axis} div {block} as int)")
        homes = F.array_compact(F.array(F.when(b < count, b), F.when((F.expr(f"c{axis} % {block}") == 0) & (b > 0) & (b <= count), b - 1)))
        rows = rows.withColumn(f"b{axis}", F.explode(homes))
    block_id = idx_of(tuple(counts), *[F.col(f"b{i}") for i in range(len(dims))])
    pos = idx_of(tuple([block + 1] * len(dims)), *[F.col(f"c{i}") - F.col(f"b{i}") * block for i in range(len(dims))])
    return rows.select(block_id.alias("block_id"), pos.cast("int").alias("pos"), "v")


def sample_sperr(cells: DataFrame, dims: Sequence[int], block: int, rate: float = 0.1, eb: float | None = None, var_first: bool = False) -> DataFrame:
    """(block_id, pos, v) of sampled blocks.

    Uniform: every int(1 / rate)-th in raster order.  var_first: the blocks of largest variance.  With eb, only blocks
    whose corners differ by more than it are considered.
    """
    total = sperr_blocks(dims, block)
    members = sperr_members(cells, dims, block)
    if eb is None and not var_first:
        return members.where(F.col("block_id") % max(1, int(1 / rate)) == 0)
    chosen = members.select("block_id").distinct() if eb is None else profile_blocks(members, len(dims), block, eb).select("block_id")
    count = max(1, int(total * rate))
    if var_first:
        variance = members.join(chosen, "block_id", "left_semi").groupBy("block_id").agg(F.var_pop("v").alias("variance"))
        picked = variance.orderBy(F.desc("variance"), "block_id").limit(count).select("block_id")
    else:
        kept = chosen.count()
        picked = chosen.withColumn("n", F.row_number().over(Window.orderBy("block_id")) - 1).where(F.col("n") % max(1, int(kept / (total * rate))) == 0).select("block_id")
    return members.join(picked, "block_id", "left_semi")


def profile_blocks(members: DataFrame, rank: int, block: int, eb: float, stride: int | None = None) -> DataFrame:
    """(block_id, corner_range) of the blocks whose strided corners differ by more than eb."""
    stride, at, keep = stride or block, F.col("pos"), F.lit(True)
    for _ in range(rank):
        keep = keep & ((at % (block + 1)) % stride == 0)
        at = F.floor(at / (block + 1))
    ranges = members.where(keep).groupBy("block_id").agg((F.max("v") - F.min("v")).cast("double").alias("corner_range"))
    return ranges.where(F.col("corner_range") > eb)


def anchor_grid(cells: DataFrame, rank: int, step: int) -> DataFrame:
    """Every step-th point along each axis."""
    keep = F.lit(True)
    for axis in range(rank):
        keep = keep & (F.col(f"c{axis}") % step == 0)
    return cells.where(keep)


def tile_pairs(cells: DataFrame, rank: int, tile: int, block: int) -> DataFrame:
    """Two sub-blocks of every tile: one at its start, one at its centre; (tile coordinates, half, v)."""
    first, second = F.lit(True), F.lit(True)
    for axis in range(rank):
        at = F.expr(f"c{axis} % {tile}")
        first = first & (at < block)
        second = second & (at >= tile // 2) & (at < tile // 2 + block)
    half = F.when(first, F.lit(0)).when(second, F.lit(1))
    return cells.withColumn("half", half).where("half is not null")


def chunk_volume(dims: Sequence[int], chunk: Sequence[int]) -> list[tuple[int, ...]]:
    """(start, length) for each axis of each tile; a rest over half a tile stands alone, a smaller one joins the last."""
    axes = []
    for size, step in zip(dims, chunk, strict=True):
        count = max(1, size // step + (size % step > step // 2))
        axes.append([(i * step, (step if i + 1 < count else size - i * step)) for i in range(count)])
    out: list[tuple[int, ...]] = [()]
    for axis in axes:
        out = [(*o, *a) for o in out for a in axis]
    return out


def gather_chunk(cells: DataFrame, tile: tuple[int, ...]) -> DataFrame:
    """The cells of a tile with positions of their own."""
    rank = len(tile) // 2
    keep, new = F.lit(True), []
    for axis in range(rank):
        start, length = tile[2 * axis], tile[2 * axis + 1]
        keep = keep & (F.col(f"c{axis}") >= start) & (F.col(f"c{axis}") < start + length)
        new.append(F.col(f"c{axis}") - start)
    return cells.where(keep).select(idx_of(tile[1::2], *new).alias("idx"), "v")


def scatter_chunk(cells: DataFrame, tile: tuple[int, ...], dims: Sequence[int]) -> DataFrame:
    """The inverse of gather_chunk: positions in the whole field."""
    from fieldloom.sources.fixtures import coords

    rank = len(tile) // 2
    inner = coords(cells, tile[1::2])
    return inner.select(idx_of(tuple(dims), *[F.col(f"c{i}") + tile[2 * i] for i in range(rank)]).alias("idx"), "v")


def prefilter(cells: DataFrame, low: float, high: float, default: float) -> DataFrame:
    """Values outside [low, high] become default."""
    return cells.withColumn("v", F.when(F.col("v").between(low, high), F.col("v")).otherwise(F.lit(default).cast("float")))


def trim_to_zero(cells: DataFrame, eb: float) -> DataFrame:
    return cells.withColumn("v", F.when(F.abs(F.col("v").cast("double")) <= eb, F.lit(0.0).cast("float")).otherwise(F.col("v")))


def transpose(cells: DataFrame, dims: Sequence[int], order: Sequence[int]) -> DataFrame:
    """Axes in another order: only positions change."""
    return cells.select(idx_of(tuple(dims[i] for i in order), *[F.col(f"c{i}") for i in order]).alias("idx"), "v")
