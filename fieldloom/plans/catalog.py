"""The registered queries over numeric fields, each next to its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import bits, kit, metadata
from fieldloom.operators import predict, sampling, selection, ssim, stats
from fieldloom.operators.codecs import ALGORITHMS, CODECS
from fieldloom.operators.surrogates.bounds import of_bounds
from fieldloom.operators.surrogates import szp, szx
from fieldloom.operators.windows import prefix_sum, shifted
from fieldloom.sources.fixtures import coords, fixture, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STEP = 10.0  # the reconstruction that metrics compare with rounds to 1 / STEP
D = "CAST(v AS DOUBLE)"
Y = f"CAST(CAST(floor({D} * 10 + 0.5) / 10 AS FLOAT) AS DOUBLE)"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has any."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c):
    return (F.floor(c.cast("double") * STEP + 0.5) / STEP).cast("float")


def pairs(field) -> DataFrame:
    """(idx, x, y) of a field and its rounded self; one scan, as both come from the same cells."""
    return field.cells.select("idx", F.col("v").cast("double").alias("x"), rounded(F.col("v")).cast("double").alias("y"))


def pairs_sql(view: str, extra: str = "") -> str:
    return f"pairs AS (SELECT idx{extra}, {D} AS x, {Y} AS y FROM {view})"


# --- catalog, statistics, metrics -------------------------------------------------------------------------------------


@query("""SELECT * FROM (
  SELECT 'events' AS field_id, 'float' AS dtype, 1 AS ndim, CAST(count(*) AS VARCHAR) AS dims, count(*) AS num FROM events
  UNION ALL SELECT 'orders', 'float', 1, CAST(count(*) AS VARCHAR), count(*) FROM orders
  UNION ALL SELECT 'part', 'float', 1, CAST(count(*) AS VARCHAR), count(*) FROM part
  UNION ALL SELECT 'emb2d', 'float', 2, count(*) || 'x' || max(len(embedding)), count(*) * max(len(embedding)) FROM embeddings)""")
def field_catalog(spark, d):
    rows = []
    for name in ("events", "orders", "part", "emb2d"):
        f = fixture(spark, d, name)
        rows.append((name, f.dtype, len(f.dims), "x".join(map(str, f.dims)), f.n))
    return spark.createDataFrame(rows, "field_id string, dtype string, ndim int, dims string, num long")


@query(" UNION ALL ".join(f"SELECT '{n}' AS field_id, CAST(min({c}) AS DOUBLE) AS min_v, CAST(max({c}) AS DOUBLE) AS max_v, CAST(max({c}) - min({c}) AS DOUBLE) AS value_range FROM (SELECT CAST({s} AS FLOAT) AS {c} FROM {n})" for n, c, s in (("events", "v", "value"), ("orders", "v", "o_totalprice"), ("part", "v", "p_retailprice"))))
def value_range(spark, d):
    out = None
    for name in ("events", "orders", "part"):
        row = stats.value_range(fixture(spark, d, name).cells).select(F.lit(name).alias("field_id"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(with_sql("walk") + " SELECT CAST(max(v) AS DOUBLE) AS get_range FROM walk")
def get_range_max(spark, d):
    return stats.get_range(fixture(spark, d, "walk").cells)


@query(with_sql("events") + ", " + pairs_sql("f_events") + """ SELECT round(sqrt(avg((x-y)*(x-y))), 6) AS rmse, round(max(abs(x-y)), 6) AS linf,
  round(10*log10((max(x)-min(x))*(max(x)-min(x))/avg((x-y)*(x-y))), 6) AS psnr, min(x) AS min_v, max(x) AS max_v FROM pairs""")
def calc_stats(spark, d):
    return stats.calc_stats(pairs(fixture(spark, d, "events")))


@query(with_sql("events") + ", " + pairs_sql("f_events") + """ SELECT round(max(abs(x-y)), 6) AS max_abs_err, round(max(abs(x-y))/(max(x)-min(x)), 6) AS max_rel_err,
  round(max(CASE WHEN x <> 0 THEN abs((x-y)/x) END), 6) AS max_pw_rel_err, round(20*log10(max(x)-min(x)) - 10*log10(avg((x-y)*(x-y))), 6) AS psnr,
  round(sqrt(avg((x-y)*(x-y)))/(max(x)-min(x)), 6) AS nrmse, round(sqrt(sum((x-y)*(x-y))), 4) AS norm_err,
  round(sqrt(sum((x-y)*(x-y)))/sqrt(sum(x*x)), 6) AS normed_norm_err, round(corr(x, y), 6) AS pearson FROM pairs""")
def verify_stats(spark, d):
    return stats.verify(pairs(fixture(spark, d, "events")))


@query(with_sql("walk") + f" SELECT round(var_pop({D})/((max({D})-min({D}))*(max({D})-min({D}))), 6) AS normed_variance FROM walk")
def normed_variance(spark, d):
    return stats.normed_variance(fixture(spark, d, "walk").cells)


@query(with_sql("events") + ", " + pairs_sql("f_events") + """ SELECT round(avg((x-y)*(x-y)), 6) AS mse, round(sqrt(avg((x-y)*(x-y))), 6) AS rmse,
  round(-20*log10(sqrt(avg((x-y)*(x-y)))/(max(x)-min(x)) + 1e-16), 6) AS psnr FROM pairs""")
def psnr_eps(spark, d):
    return stats.psnr(pairs(fixture(spark, d, "events")))


LAG1 = """m AS (SELECT avg(a) AS m, var_pop(a) AS var, count(*) AS n FROM e),
  near AS (SELECT a, lead(a) OVER (ORDER BY idx) AS b FROM e)
  SELECT round(CASE WHEN max(var) = 0 THEN {constant} ELSE sum((a-m)*(b-m))/(max(n)-1)/max(var) END, 6) AS autocorrelation FROM near, m WHERE b IS NOT NULL"""


@query(with_sql("walk") + f", e AS (SELECT idx, {D} AS a FROM walk), " + LAG1.format(constant="0.0::DOUBLE"))
def autocorr_data(spark, d):
    return stats.lag1(fixture(spark, d, "walk").cells, "v", 0.0)


@query(with_sql("walk") + ", " + pairs_sql("walk") + ", e AS (SELECT idx, x - y AS a FROM pairs), " + LAG1.format(constant="1.0::DOUBLE"))
def autocorr_error(spark, d):
    return stats.lag1(pairs(fixture(spark, d, "walk")).select("idx", (F.col("x") - F.col("y")).alias("e")), "e", 1.0)


@query(with_sql("walk") + ", " + pairs_sql("walk") + """, e AS (SELECT idx // 100 AS block_id, idx, x - y AS a FROM pairs),
  m AS (SELECT block_id, avg(a) AS m, var_pop(a) AS var, count(*) AS n FROM e GROUP BY ALL),
  near AS (SELECT block_id, a, lead(a) OVER (PARTITION BY block_id ORDER BY idx) AS b FROM e)
  SELECT block_id, round(CASE WHEN max(var) = 0 THEN 1.0::DOUBLE ELSE sum((a-m)*(b-m))/(max(n)-1)/max(var) END, 4) AS autocorrelation
  FROM near JOIN m USING (block_id) WHERE b IS NOT NULL GROUP BY block_id""")
def autocorr_error_block(spark, d):
    return stats.lag1_blocks(pairs(fixture(spark, d, "walk")), 100)


@query(with_sql("emb2d") + f" SELECT c0 // 8 AS b0, c1 // 8 AS b1, count(*) AS cells, round(avg({D}), 6) AS mean, round(var_pop({D}), 4) AS variance, round(max({D})-min({D}), 6) AS value_range FROM emb2d GROUP BY ALL")
def block_profile(spark, d):
    return stats.block_profile(fixture(spark, d, "emb2d").with_coords(), 8, 2)


@query(with_sql("cube3d") + f" SELECT c0 // 5 AS b0, c1 // 5 AS b1, c2 // 5 AS b2, round(covar_pop({D}, {Y}), 4) AS covariance FROM cube3d GROUP BY ALL")
def block_covariance(spark, d):
    return stats.block_covariance(fixture(spark, d, "cube3d").with_coords().withColumn("w", rounded(F.col("v"))), 5, 3)


@query(with_sql("walk") + f""", s AS (SELECT CASE WHEN n % 2048 = 0 THEN 2048 WHEN n % 1024 = 0 THEN 1024 WHEN n % 512 = 0 THEN 512 WHEN n % 256 = 0 THEN 256 WHEN n % 128 = 0 THEN 128 WHEN n % 64 = 0 THEN 64
    WHEN n % 32 = 0 THEN 32 WHEN n % 16 = 0 THEN 16 WHEN n % 8 = 0 THEN 8 WHEN n % 4 = 0 THEN 4 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS s, n FROM (SELECT count(*) AS n FROM walk)),
  e AS (SELECT idx // (n // s) AS k, avg({D}) AS m, avg({D}*{D}) AS q FROM walk, s GROUP BY ALL)
  SELECT count(*) AS strides, round(avg(m), 6) AS mean, round(sqrt(avg(q)), 6) AS rms FROM e""")
def mean_rms_strides(spark, d):
    f = fixture(spark, d, "walk")
    return stats.mean_rms_strides(f.cells, f.n)


@query(with_sql("part") + " SELECT idx // 10 AS block_id, min(v) = max(v) AS is_constant, CAST(min(v) AS DOUBLE) AS value FROM (SELECT idx, CAST(floor(CAST(v AS DOUBLE) / 50) AS FLOAT) AS v FROM f_part) GROUP BY ALL")
def constant_blocks(spark, d):
    cells = fixture(spark, d, "part").cells
    return stats.constant_blocks(cells.withColumn("v", F.floor(F.col("v").cast("double") / 50).cast("float")), 10)


@query(with_sql("walk") + f" SELECT round(var_pop({D}), 4) AS variance, round(sum({D}), 4) AS total FROM walk")
def stride_variance(spark, d):
    return stats.stride_variance(fixture(spark, d, "walk").cells)


@query(with_sql("walk") + f" SELECT round(sqrt(avg(r*r)), 6) AS rmse FROM (SELECT {D} - 0.75*floor({D}/0.75+0.5) AS r FROM walk)")
def rmse_at_step(spark, d):
    return stats.rmse_at_step(fixture(spark, d, "walk").cells, 0.75)


# --- windowed similarity ----------------------------------------------------------------------------------------------


def ssim_sql(axes: list[tuple[str, str]], extra: str = "") -> str:
    """axes: (window expression, condition that the window is whole)."""
    keys = ", ".join(f"{e} AS w{i}" for i, (e, _) in enumerate(axes))
    where = " AND ".join(c for _, c in axes)
    return f""", m AS (SELECT {keys}, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cov, max(x) - min(x) AS r0 FROM pairs{extra} WHERE {where} GROUP BY ALL),
  c AS (SELECT *, CASE WHEN r0 = 0 THEN 1.0 ELSE r0 END AS r FROM m), k AS (SELECT *, (0.01*r)*(0.01*r) AS c1, (0.03*r)*(0.03*r) AS c2 FROM c)
  SELECT count(*) AS windows, round(avg((2*mx*my+c1)/(mx*mx+my*my+c1) * ((2*sqrt(vx)*sqrt(vy)+c2)/(vx+vy+c2)) * ((cov+c2/2)/(sqrt(vx)*sqrt(vy)+c2/2))), 6) AS ssim FROM k"""


@query(with_sql("walk") + ", " + pairs_sql("walk") + ssim_sql([("idx // 8", "idx // 8 <= (SELECT (count(*) - 8) // 8 FROM walk)")]))
def ssim_1d(spark, d):
    f = fixture(spark, d, "walk")
    return ssim.mean_ssim(coords(pairs(f), f.dims), f.dims)


@query(with_sql("emb2d") + ", " + pairs_sql("emb2d", ", c0, c1") + ssim_sql([("c0 // 8", "c0 // 8 <= (SELECT (max(c0) + 1 - 8) // 8 FROM emb2d)"), ("c1 // 8", "c1 // 8 <= (SELECT (max(c1) + 1 - 8) // 8 FROM emb2d)")]))
def ssim_2d(spark, d):
    f = fixture(spark, d, "emb2d")
    return ssim.mean_ssim(coords(pairs(f), f.dims), f.dims)


@query(with_sql("cube3d") + ", " + pairs_sql("cube3d", ", c0, c1, c2") + ssim_sql([(f"c{i} // 8", f"c{i} // 8 <= (SELECT (d{i} - 8) // 8 FROM shape3)") for i in range(3)]))
def ssim_3d(spark, d):
    f = fixture(spark, d, "cube3d")
    return ssim.mean_ssim(coords(pairs(f), f.dims), f.dims)


@query(with_sql("walk4") + ", " + pairs_sql("walk4", ", c0, c1, c2, c3") + ssim_sql([(f"c{i} // 4", f"c{i} // 4 <= (SELECT (k - 4) // 4 FROM side4)") for i in range(4)]))
def ssim_4d(spark, d):
    f = fixture(spark, d, "walk4")
    return ssim.mean_ssim(coords(pairs(f), f.dims), f.dims, 4, 4)


@query(with_sql("walk") + ", " + pairs_sql("walk") + ", n AS (SELECT count(*) AS n FROM walk)" + ", ex AS (SELECT x, y, unnest(range(greatest(0, (idx - 8 + 3) // 3), least((n - 8) // 3, idx // 3) + 1)) AS w FROM pairs, n)" + ssim_sql([("w", "true")]).replace("FROM pairs", "FROM ex"))
def ssim_overlap(spark, d):
    f = fixture(spark, d, "walk")
    return ssim.mean_ssim(coords(pairs(f), f.dims), f.dims, 8, 3)


@query(with_sql("walk") + ", " + pairs_sql("walk") + """, m AS (SELECT idx // 50 AS block_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cov FROM pairs GROUP BY ALL)
  SELECT block_id, round((2*mx*my+0.01)*(2*cov+0.03)/((mx*mx+my*my+0.01)*(vx+vy+0.03)), 6) AS ssim FROM m""")
def ssim_moments(spark, d):
    m = pairs(fixture(spark, d, "walk")).groupBy(F.expr("idx div 50").alias("block_id")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"))
    return m.select("block_id", F.round(ssim.compact(*(F.col(c) for c in ("mx", "my", "vx", "vy", "cov")), F.lit(0.01), F.lit(0.03)), 6).alias("ssim"))


# --- order-dependent --------------------------------------------------------------------------------------------------


@query(with_sql("part") + """, c AS (SELECT idx, CAST(floor(CAST(v AS DOUBLE)/25) AS BIGINT) AS value FROM f_part), l AS (SELECT *, CASE WHEN lag(value) OVER (ORDER BY idx) IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS new FROM c),
  r AS (SELECT *, sum(new) OVER (ORDER BY idx) AS run FROM l) SELECT min(idx) AS start, min(value) AS value, count(*) AS length FROM r GROUP BY run""")
def rle_runs(spark, d):
    cells = fixture(spark, d, "part").cells
    return predict.runs(cells.select("idx", F.floor(F.col("v").cast("double") / 25).cast("long").alias("value")), "value")


@query(with_sql("walk") + """, s AS (SELECT idx // 256 AS idx, CAST(sum(CASE WHEN v < 0 THEN 5 ELSE 3 END) AS BIGINT) AS bytes FROM walk GROUP BY ALL)
  SELECT idx AS chunk, bytes, CAST(sum(bytes) OVER (ORDER BY idx) AS BIGINT) - bytes AS "offset" FROM s""")
def chunk_offsets(spark, d):
    s = fixture(spark, d, "walk").cells.groupBy(F.expr("idx div 256").alias("idx")).agg(F.sum(F.when(F.col("v") < 0, 5).otherwise(3)).alias("bytes"))
    return prefix_sum(s, "bytes", "upto").select(F.col("idx").alias("chunk"), "bytes", (F.col("upto") - F.col("bytes")).alias("offset"))


@query("""WITH axis AS (SELECT * FROM (VALUES (0, 25, 8), (1, 20, 8), (2, 20, 6)) t(a, size, step)),
  n AS (SELECT *, greatest(1, size // step + CASE WHEN size % step > step // 2 THEN 1 ELSE 0 END) AS n FROM axis),
  t AS (SELECT a, i * step AS start, CASE WHEN i + 1 < n THEN step ELSE size - i * step END AS len FROM (SELECT *, unnest(range(n)) AS i FROM n))
  SELECT x.start AS s0, x.len AS l0, y.start AS s1, y.len AS l1, z.start AS s2, z.len AS l2 FROM t x, t y, t z WHERE x.a = 0 AND y.a = 1 AND z.a = 2""")
def chunk_volume(spark, d):
    return spark.createDataFrame(sampling.chunk_volume((25, 20, 20), (8, 8, 6)), "s0 long, l0 long, s1 long, l1 long, s2 long, l2 long")


# --- samples ----------------------------------------------------------------------------------------------------------


@query(with_sql("walk") + ", n AS (SELECT count(*) // 32 AS whole FROM walk) SELECT (idx // 32) // 5 * 32 + idx % 32 AS idx, v, idx AS source_idx FROM walk, n WHERE idx // 32 < whole AND (idx // 32) % 5 = 0")
def sample_1d(spark, d):
    f = fixture(spark, d, "walk")
    return sampling.sample_blocks(f.with_coords(), f.dims, 32, 5)[0]


@query(with_sql("emb2d") + """, n AS (SELECT (max(c0) + 1) // 8 AS w0, (max(c1) + 1) // 8 AS w1 FROM emb2d)
  SELECT CAST(((c0 // 8) // 3 * 8 + c0 % 8) AS BIGINT) * (((w1 + 2) // 3) * 8) + ((c1 // 8) // 3 * 8 + c1 % 8) AS idx, v, idx AS source_idx FROM emb2d, n
  WHERE c0 // 8 < w0 AND c1 // 8 < w1 AND (c0 // 8) % 3 = 0 AND (c1 // 8) % 3 = 0""")
def sample_2d(spark, d):
    f = fixture(spark, d, "emb2d")
    return sampling.sample_blocks(f.with_coords(), f.dims, 8, 3)[0]


@query(with_sql("cube3d") + """, n AS (SELECT d0 // 4 AS w0, d1 // 4 AS w1, d2 // 4 AS w2 FROM shape3)
  SELECT (CAST((c0 // 4) // 2 * 4 + c0 % 4 AS BIGINT) * (((w1 + 1) // 2) * 4) + ((c1 // 4) // 2 * 4 + c1 % 4)) * (((w2 + 1) // 2) * 4) + ((c2 // 4) // 2 * 4 + c2 % 4) AS idx, v, idx AS source_idx FROM cube3d, n
  WHERE c0 // 4 < w0 AND c1 // 4 < w1 AND c2 // 4 < w2 AND (c0 // 4) % 2 = 0 AND (c1 // 4) % 2 = 0 AND (c2 // 4) % 2 = 0""")
def sample_3d(spark, d):
    f = fixture(spark, d, "cube3d")
    return sampling.sample_blocks(f.with_coords(), f.dims, 4, 2)[0]


SZX_SAMPLE = "s AS (SELECT idx // 384 AS block_id, CAST(idx % 384 AS INTEGER) AS pos, v FROM {view}, (SELECT count(*) // 384 AS nb FROM {view}) WHERE idx // 384 < nb AND idx % 384 < 128)"


@query(with_sql("walk") + ", " + SZX_SAMPLE.format(view="walk") + " SELECT * FROM s")
def sample_szx(spark, d):
    f = fixture(spark, d, "walk")
    return sampling.sample_szx(f.cells, f.n, 3)[0]


@query(with_sql("walk") + """, p AS (SELECT n, m, m // 4 AS blocks, greatest(1, CAST(floor((n // 4) / (m // 4) + 0.5) AS BIGINT)) * 4 AS step FROM (SELECT n, CAST(floor(n * 0.2) AS BIGINT) // 4 * 4 AS m FROM (SELECT count(*) AS n FROM walk))),
  hit AS (SELECT idx // step * 4 + idx % step AS idx, v, idx AS source_idx FROM walk, p WHERE idx // step < blocks AND idx % step < 4 AND idx // step * step + 4 < n)
  SELECT g.idx, coalesce(v, 0.0::FLOAT) AS v, source_idx FROM (SELECT unnest(range(m)) AS idx FROM p) g LEFT JOIN hit USING (idx)""")
def sample_zfp_1d(spark, d):
    f = fixture(spark, d, "walk")
    return sampling.sample_zfp(f.with_coords(), f.dims)[0]


def zfp_sample_sql(rank: int, sizes: list[str], view: str, extra: str = "") -> str:
    """Starts along each axis by the rule, joined to the cells."""
    ctes, joins, at = [], [], "0::BIGINT"
    for i, size in enumerate(sizes):
        ctes.append(f"k{i} AS (SELECT blocks, greatest(1, CAST(floor(pow(0.2, 1.0/{rank}) * blocks) AS BIGINT)) AS k FROM (SELECT ({size}) // 4 AS blocks))")
        ctes.append(f"s{i} AS (SELECT i, k, CASE WHEN k > 1 THEN CAST(floor(i / (k - 1) * (blocks - 1) + 0.5) AS BIGINT) * 4 ELSE 0 END AS s FROM (SELECT *, unnest(range(k)) AS i FROM k{i}))")
        joins.append(f"JOIN s{i} ON c{i} // 4 * 4 = s{i}.s")
        at = f"({at} * (s{i}.k * 4) + s{i}.i * 4 + c{i} % 4)"
    return with_sql(view) + ", " + ", ".join(ctes) + f" SELECT CAST({at} AS BIGINT) AS idx, v, idx AS source_idx FROM {view} " + " ".join(joins)


@query(zfp_sample_sql(2, ["SELECT max(c0) + 1 FROM emb2d", "SELECT max(c1) + 1 FROM emb2d"], "emb2d"))
def sample_zfp_2d(spark, d):
    f = fixture(spark, d, "emb2d")
    return sampling.sample_zfp(f.with_coords(), f.dims)[0]


@query(zfp_sample_sql(3, ["SELECT d0 FROM shape3", "SELECT d1 FROM shape3", "SELECT d2 FROM shape3"], "cube3d"))
def sample_zfp_3d(spark, d):
    f = fixture(spark, d, "cube3d")
    return sampling.sample_zfp(f.with_coords(), f.dims)[0]


SPERR_MEMBERS = """n AS (SELECT len(range(0, d0 - 8, 8)) AS n0, len(range(0, d1 - 8, 8)) AS n1, len(range(0, d2 - 8, 8)) AS n2 FROM shape3),
  b AS (SELECT x AS b0, y AS b1, z AS b2, (x * n1 + y) * n2 + z AS block_id FROM n, unnest(range(n0)) a(x), unnest(range(n1)) bb(y), unnest(range(n2)) c(z)),
  members AS (SELECT block_id, CAST(((c0 - b0 * 8) * 9 + (c1 - b1 * 8)) * 9 + (c2 - b2 * 8) AS INTEGER) AS pos, v FROM cube3d JOIN b ON c0 BETWEEN b0 * 8 AND b0 * 8 + 8 AND c1 BETWEEN b1 * 8 AND b1 * 8 + 8 AND c2 BETWEEN b2 * 8 AND b2 * 8 + 8)"""


@query(with_sql("cube3d") + ", " + SPERR_MEMBERS + " SELECT block_id, pos, v FROM members WHERE block_id % 2 = 0")
def sample_sperr_blocks(spark, d):
    f = fixture(spark, d, "cube3d")
    return sampling.sample_sperr(f.with_coords(), f.dims, 8, 0.5)


@query(with_sql("cube3d") + ", " + SPERR_MEMBERS + """ SELECT block_id, CAST(max(v) - min(v) AS DOUBLE) AS corner_range FROM members
  WHERE (pos % 9) % 4 = 0 AND (pos // 9 % 9) % 4 = 0 AND (pos // 81) % 4 = 0 GROUP BY ALL HAVING max(v) - min(v) > 100""")
def profile_filter(spark, d):
    f = fixture(spark, d, "cube3d")
    return sampling.profile_blocks(sampling.sperr_members(f.with_coords(), f.dims, 8), 3, 8, 100.0, 4)


@query(with_sql("cube3d") + ", " + SPERR_MEMBERS + """, var AS (SELECT block_id, var_pop(CAST(v AS DOUBLE)) AS var FROM members GROUP BY ALL)
  SELECT block_id, pos, v FROM members WHERE block_id IN (SELECT block_id FROM var ORDER BY var DESC, block_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.5) AS BIGINT)) FROM b))""")
def variance_top_blocks(spark, d):
    f = fixture(spark, d, "cube3d")
    return sampling.sample_sperr(f.with_coords(), f.dims, 8, 0.5, var_first=True)


@query(with_sql("cube3d") + " SELECT idx, v, c0, c1, c2 FROM cube3d WHERE c0 % 8 = 0 AND c1 % 8 = 0 AND c2 % 8 = 0")
def anchor_grid(spark, d):
    return sampling.anchor_grid(fixture(spark, d, "cube3d").with_coords(), 3, 8).select("idx", "v", "c0", "c1", "c2")


@query(with_sql("emb2d") + """, h AS (SELECT idx, v, CASE WHEN c0 % 16 < 4 AND c1 % 16 < 4 THEN 0 WHEN c0 % 16 BETWEEN 8 AND 11 AND c1 % 16 BETWEEN 8 AND 11 THEN 1 END AS half FROM emb2d)
  SELECT idx, v, half FROM h WHERE half IS NOT NULL""")
def tile_pairs(spark, d):
    return sampling.tile_pairs(fixture(spark, d, "emb2d").with_coords(), 2, 16, 4).select("idx", "v", "half")


@query(with_sql("cube3d") + " SELECT idx, CASE WHEN v BETWEEN -50 AND 50 THEN v ELSE 0.0::FLOAT END AS v FROM cube3d")
def prefilter_range(spark, d):
    return sampling.prefilter(fixture(spark, d, "cube3d").cells, -50.0, 50.0, 0.0)


@query(with_sql("cube3d") + f" SELECT idx, CASE WHEN abs({D}) <= 25 THEN 0.0::FLOAT ELSE v END AS v FROM cube3d")
def trim_to_zero(spark, d):
    return sampling.trim_to_zero(fixture(spark, d, "cube3d").cells, 25.0)


@query(with_sql("cube3d") + " SELECT (CAST(c2 AS BIGINT) * d0 + c0) * d1 + c1 AS idx, v FROM cube3d, shape3")
def transpose_axes(spark, d):
    f = fixture(spark, d, "cube3d")
    return sampling.transpose(f.with_coords(), f.dims, (2, 0, 1))


@query(with_sql("cube3d") + " SELECT (CAST(c0 - 2 AS BIGINT) * 4 + (c1 - 3)) * 6 + (c2 - 1) AS idx, v FROM cube3d WHERE c0 BETWEEN 2 AND 6 AND c1 BETWEEN 3 AND 6 AND c2 BETWEEN 1 AND 6")
def gather_chunk(spark, d):
    return sampling.gather_chunk(fixture(spark, d, "cube3d").with_coords(), (2, 5, 3, 4, 1, 6))


@query(with_sql("cube3d") + " SELECT idx, v FROM cube3d WHERE c0 BETWEEN 2 AND 6 AND c1 BETWEEN 3 AND 6 AND c2 BETWEEN 1 AND 6")
def scatter_chunk(spark, d):
    f, tile = fixture(spark, d, "cube3d"), (2, 5, 3, 4, 1, 6)
    return sampling.scatter_chunk(sampling.gather_chunk(f.with_coords(), tile), tile, f.dims)


# --- quantization and codes -------------------------------------------------------------------------------------------

QUANT = f"""p AS (SELECT idx, v, coalesce(lag(v) OVER (ORDER BY idx), 0.0::FLOAT) AS pred FROM walk),
  s AS (SELECT *, {D} - CAST(pred AS DOUBLE) AS diff, CAST((trunc(abs({D} - CAST(pred AS DOUBLE)) / 4.0) + 1) AS BIGINT) // 2 AS steps FROM p),
  r AS (SELECT *, CASE WHEN diff < 0 THEN -steps ELSE steps END AS q, CAST(CAST(pred AS DOUBLE) + 2 * (CASE WHEN diff < 0 THEN -steps ELSE steps END) * 4.0::DOUBLE AS FLOAT) AS recon0 FROM s),
  quant AS (SELECT idx, v, pred, CASE WHEN steps < 32768 AND abs(CAST(recon0 AS DOUBLE) - {D}) <= 4.0 THEN CAST(q + 32768 AS INTEGER) ELSE 0 END AS code,
    CASE WHEN steps < 32768 AND abs(CAST(recon0 AS DOUBLE) - {D}) <= 4.0 THEN recon0 ELSE v END AS recon FROM r)"""


def _quantized(spark, d):
    return predict.quantized_1d(fixture(spark, d, "walk").cells, 4.0)


@query(with_sql("walk") + ", " + QUANT + " SELECT idx, code, recon FROM quant")
def linear_quantize(spark, d):
    return _quantized(spark, d).select("idx", "code", "recon")


@query(with_sql("walk") + ", " + QUANT + " SELECT idx, recon AS v FROM quant")
def dequantize(spark, d):
    q = _quantized(spark, d)
    return q.select("idx", F.when(F.col("code") == 0, F.col("v")).otherwise(predict.dequantize(F.col("pred"), F.col("code"), 4.0)).alias("v"))


@query(with_sql("walk") + ", " + QUANT + " SELECT code, count(*) AS cnt FROM quant GROUP BY ALL")
def quant_histogram(spark, d):
    return predict.code_histogram(_quantized(spark, d))


ENTROPY = """h AS (SELECT code, count(*) AS cnt FROM {codes} GROUP BY ALL), t AS (SELECT sum(cnt)::DOUBLE AS total FROM h), pr AS (SELECT code, cnt / total AS p, -log2(cnt / total) AS bit FROM h, t),
  e AS (SELECT sum(CASE WHEN code = 0 THEN p * 32 WHEN bit >= 32 THEN 0 WHEN bit < 1 THEN p * CASE WHEN code = 32768 THEN 1 WHEN abs(code - 32768) = 1 THEN 2.5 ELSE 4 END ELSE p * bit END) AS bits,
    coalesce(max(CASE WHEN code = 32768 THEN p END), 0) AS p0 FROM pr)"""


@query(with_sql("walk") + ", " + QUANT + ", " + ENTROPY.format(codes="quant") + """, g AS (SELECT *, CASE WHEN p0 > 0.5 THEN p0 / bits WHEN p0 > 0 THEN -(p0 * log2(p0)) / bits ELSE 0 END AS s FROM e)
  SELECT round(bits, 6) AS bits, round(32 / bits, 6) AS cr, round(32 / (bits / (1 / ((1 - p0) * s + (1 - s)))), 6) AS lossless_cr FROM g""")
def entropy_bits(spark, d):
    e = predict.after_lossless(predict.entropy(predict.code_histogram(_quantized(spark, d))))
    return e.select(*[F.round(c, 6).alias(c) for c in ("bits", "cr", "lossless_cr")])


@query(with_sql("walk") + ", " + QUANT + " SELECT code - 32768 AS bin, count(*) AS cnt FROM quant WHERE code <> 0 AND abs(code - 32768) <= 5 GROUP BY ALL")
def near_zero_bins(spark, d):
    return predict.near_zero_bins(_quantized(spark, d))


@query(with_sql("walk") + ", " + QUANT + " SELECT code, count(*) AS cnt FROM quant GROUP BY ALL ORDER BY cnt DESC, code LIMIT 5")
def topk_codes(spark, d):
    return predict.top_codes(predict.code_histogram(_quantized(spark, d)))


@query()
def huffman_bits(spark, d):
    return predict.huffman_bits(_quantized(spark, d))


# --- predictors -------------------------------------------------------------------------------------------------------

NEIGHBOURS = (-7, -5, -3, -1, 1, 2, 3, 5)
NEAR = ", ".join(f"CAST({'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER (ORDER BY idx) AS DOUBLE) AS {'m' if k < 0 else 'p'}{abs(k)}" for k in NEIGHBOURS)


@query(with_sql("walk") + f", n AS (SELECT idx, {NEAR} FROM walk) SELECT idx, " + ", ".join(f"round({' + '.join(f'{w!r} * {n}' for n, w in zip(*predict.STENCILS[k], strict=True))}, 4) AS {k}" for k in predict.STENCILS) + " FROM n")
def interp_formulas(spark, d):
    names = {("m" if k < 0 else "p") + str(abs(k)): ("v", k) for k in NEIGHBOURS}
    near = shifted(fixture(spark, d, "walk").cells, names)
    at = {n: F.col(n).cast("double") for n in names}
    return near.select("idx", *[F.round(predict.interpolate(k, **at), 4).alias(k) for k in predict.STENCILS])


def lorenzo_sql(view: str, rank: int, order: int) -> str:
    """The prediction as the value less its differences along all axes."""
    out, last = [f"l0 AS (SELECT *, {D} AS e0 FROM {view})"], "l0"
    for a in range(rank):
        part = ", ".join(f"c{i}" for i in range(rank) if i != a)
        w = f"({'PARTITION BY ' + part if part else ''} ORDER BY c{a})"
        e = f"e{a} - coalesce(lag(e{a}) OVER {w}, 0)" if order == 1 else f"e{a} - 2 * coalesce(lag(e{a}) OVER {w}, 0) + coalesce(lag(e{a}, 2) OVER {w}, 0)"
        out.append(f"l{a + 1} AS (SELECT *, {e} AS e{a + 1} FROM {last})")
        last = f"l{a + 1}"
    return ", ".join(out) + f", lz AS (SELECT *, {D} - e{rank} AS pred FROM {last})"


@query(with_sql("walk") + f" SELECT idx, coalesce(CAST(lag(v) OVER (ORDER BY idx) AS DOUBLE), 0) AS pred FROM walk")
def lorenzo1_1d(spark, d):
    return predict.lorenzo_1d(fixture(spark, d, "walk").cells).select("idx", "pred")


@query(with_sql("walk") + f" SELECT idx, round(2 * coalesce(CAST(lag(v) OVER (ORDER BY idx) AS DOUBLE), 0) - coalesce(CAST(lag(v, 2) OVER (ORDER BY idx) AS DOUBLE), 0), 6) AS pred FROM walk")
def lorenzo2_1d(spark, d):
    return predict.lorenzo_1d(fixture(spark, d, "walk").cells, 2).select("idx", F.round("pred", 6).alias("pred"))


@query(with_sql("emb2d") + ", " + lorenzo_sql("emb2d", 2, 1) + " SELECT idx, round(pred, 5) AS pred FROM lz")
def lorenzo1_2d(spark, d):
    return predict.lorenzo_nd(fixture(spark, d, "emb2d").with_coords(), 2).select("idx", F.round("pred", 5).alias("pred"))


@query(with_sql("emb2d") + ", " + lorenzo_sql("emb2d", 2, 2) + " SELECT idx, round(pred, 5) AS pred FROM lz")
def lorenzo2_2d(spark, d):
    return predict.lorenzo_nd(fixture(spark, d, "emb2d").with_coords(), 2, 2).select("idx", F.round("pred", 5).alias("pred"))


@query(with_sql("cube3d") + ", " + lorenzo_sql("cube3d", 3, 1) + " SELECT idx, round(pred, 4) AS pred FROM lz")
def lorenzo1_3d(spark, d):
    return predict.lorenzo_nd(fixture(spark, d, "cube3d").with_coords(), 3).select("idx", F.round("pred", 4).alias("pred"))


@query(with_sql("walk4") + ", " + lorenzo_sql("walk4", 4, 1) + " SELECT idx, round(pred, 4) AS pred FROM lz")
def lorenzo1_4d(spark, d):
    return predict.lorenzo_nd(fixture(spark, d, "walk4").with_coords(), 4).select("idx", F.round("pred", 4).alias("pred"))


@query(with_sql("cube3d") + ", " + lorenzo_sql("cube3d", 3, 2) + " SELECT idx, round(pred, 4) AS pred FROM lz")
def lorenzo2_3d(spark, d):
    return predict.lorenzo_nd(fixture(spark, d, "cube3d").with_coords(), 3, 2).select("idx", F.round("pred", 4).alias("pred"))


REGRESSION = f"""rs AS (SELECT c0 // 6 AS b0, c1 // 6 AS b1, count(*) AS num, sum({D}) AS s, sum(c0 % 6 * {D}) AS s0, sum(c1 % 6 * {D}) AS s1, max(c0 % 6) + 1 AS d0, max(c1 % 6) + 1 AS d1 FROM emb2d GROUP BY ALL),
  rc AS (SELECT *, CASE WHEN d0 > 1 THEN (2 * s0 / (d0 - 1) - s) * 6 / (num * (d0 + 1)) END AS slope0, CASE WHEN d1 > 1 THEN (2 * s1 / (d1 - 1) - s) * 6 / (num * (d1 + 1)) END AS slope1 FROM rs),
  reg AS (SELECT *, s / num - (d0 - 1) * slope0 / 2 - (d1 - 1) * slope1 / 2 AS constant FROM rc)"""


@query(with_sql("emb2d") + ", " + REGRESSION + " SELECT b0, b1, round(slope0, 4) + 0.0 AS slope0, round(slope1, 4) + 0.0 AS slope1, round(constant, 4) + 0.0 AS constant FROM reg")
def regression_block_coeffs(spark, d):
    f = fixture(spark, d, "emb2d")
    return predict.regression_blocks(f.with_coords(), f.dims, 6).select("b0", "b1", *[(F.round(c, 4) + 0.0).alias(c) for c in ("slope0", "slope1", "constant")])


@query(with_sql("emb2d") + ", " + lorenzo_sql("emb2d", 2, 1).replace("l0 ", "u0 ").replace("l1", "u1").replace("l2", "u2").replace("FROM l0", "FROM u0").replace("lz AS", "one AS") + ", " + lorenzo_sql("emb2d", 2, 2).replace("lz AS", "two AS") + ", " + REGRESSION
       + f""", er AS (SELECT e.c0 // 6 AS b0, e.c1 // 6 AS b1, sum(abs(CAST(e.v AS DOUBLE) - one.pred) + 0.81 * 0.01) AS lorenzo1, sum(abs(CAST(e.v AS DOUBLE) - two.pred) + 2.76 * 0.01) AS lorenzo2,
    sum(abs(CAST(e.v AS DOUBLE) - (constant + slope0 * (e.c0 % 6) + slope1 * (e.c1 % 6)))) AS regression
    FROM emb2d e JOIN one USING (idx) JOIN two USING (idx) JOIN reg ON reg.b0 = e.c0 // 6 AND reg.b1 = e.c1 // 6 WHERE e.c0 % 6 = e.c1 % 6 GROUP BY ALL)
  SELECT b0, b1, CASE WHEN lorenzo1 <= lorenzo2 AND (lorenzo1 <= regression OR regression IS NULL) THEN 'lorenzo1' WHEN lorenzo2 <= regression OR regression IS NULL THEN 'lorenzo2' ELSE 'regression' END AS predictor FROM er""")
def predictor_choice(spark, d):
    f = fixture(spark, d, "emb2d")
    errors = predict.predictor_errors(f.with_coords(), f.dims, 6, 0.01).where("err is not null")
    return predict.best_predictor(errors, 2)


@query(with_sql("cube3d") + ", " + lorenzo_sql("cube3d", 3, 1) + f""", h AS (SELECT least(CAST(floor((round(abs({D} - pred), 4) / 0.5 + 1) / 2) AS BIGINT), 65535) AS bin, count(*) AS cnt FROM lz GROUP BY ALL),
  c AS (SELECT bin, sum(cnt) OVER (ORDER BY bin) AS upto, sum(cnt) OVER () AS total FROM h), f AS (SELECT coalesce(min(bin), 65535) AS bin FROM c WHERE upto > total * 0.999)
  SELECT bin, CAST(greatest(32, pow(2, ceil(log2(2 * (bin + 1))))) AS BIGINT) AS intervals FROM f""")
def quant_intervals(spark, d):
    e = predict.lorenzo_nd(fixture(spark, d, "cube3d").with_coords(), 3).select(F.round(F.abs(F.col("v").cast("double") - F.col("pred")), 4).alias("err"))
    return predict.quantization_intervals(e, 0.5)


@query(with_sql("walk") + f""", b AS (SELECT CAST(floor({D} / 10) AS BIGINT) AS bin, count(*) AS cnt FROM walk GROUP BY ALL), p AS (SELECT a.bin, a.cnt + coalesce(n.cnt, 0) AS pair_count FROM b a LEFT JOIN b n ON n.bin = a.bin + 1)
  SELECT bin, pair_count, (bin + 1) * 10.0::DOUBLE AS position FROM p ORDER BY pair_count DESC, bin LIMIT 1""")
def dense_position(spark, d):
    return predict.dense_position(fixture(spark, d, "walk").cells, 10.0)


@query(with_sql("walk") + f" SELECT round(avg({D}), 6) AS rough_mean FROM walk WHERE idx % 100 = 0")
def rough_mean(spark, d):
    return predict.rough_mean(fixture(spark, d, "walk").cells, 100)


# --- scalars and configurations ---------------------------------------------------------------------------------------


@query(with_sql("walk") + f""", r AS (SELECT CAST(max(v) - min(v) AS DOUBLE) AS r, count(*) AS n FROM walk)
  SELECT m AS mode, round(CASE m WHEN 'abs' THEN 0.5 WHEN 'rel' THEN 0.001 * r WHEN 'psnr' THEN r * pow(10, (60 + 10 * log10(1 - 2.0::DOUBLE / 3 * 0.99)) / -20) WHEN 'norm' THEN sqrt(3.0 / n) * 7
    WHEN 'abs_and_rel' THEN least(0.5, 0.001 * r) ELSE greatest(0.5, 0.001 * r) END, 8) AS eb FROM r, unnest(['abs', 'rel', 'psnr', 'norm', 'abs_and_rel', 'abs_or_rel']) t(m)""")
def error_bound_modes(spark, d):
    f = fixture(spark, d, "walk")
    rows = [(m, stats.error_bound(m, f.range, f.n, abs_=0.5, rel=0.001, psnr_=60.0, norm=7.0)) for m in stats.MODES]
    return spark.createDataFrame(rows, "mode string, eb double").withColumn("eb", F.round("eb", 8))


@query("""SELECT m AS method, CAST(CAST(('0b' || right(CAST(CAST(eb AS BIT) AS VARCHAR), 32)) AS VARCHAR) AS VARCHAR) AS low, ('0b' || left(CAST(CAST(eb AS BIT) AS VARCHAR), 32)) AS high, 65536 + m AS word
  FROM (SELECT unnest([1, 3, 7, 12, 13]) AS m, 1e-4::DOUBLE AS eb)""")
def cd_values_words(spark, d):
    rows = []
    for m in (1, 3, 7, 12, 13):
        low, high, word = metadata.cd_values(1e-4, m)
        rows.append((m, f"0b{low:032b}", f"0b{high:032b}", word))
    return spark.createDataFrame(rows, "method int, low string, high string, word int")


@query("""WITH m AS (SELECT unnest(['ABS', 'REL', 'VR_REL', 'ABS_AND_REL', 'ABS_OR_REL', 'PSNR', 'NORM', 'FIX_RATE', 'PW_REL']) AS mode, unnest([0, 1, 1, 2, 3, 4, 5, 6, 10]) AS number),
  b AS (SELECT mode, number, CAST(CAST(bound AS BIT) AS VARCHAR) AS bits FROM m, (SELECT 1e-3::DOUBLE AS bound))
  SELECT mode, number, '0b' || left(bits, 32) AS abs_high, '0b' || right(bits, 32) AS abs_low, CAST(11 AS BIGINT) AS words FROM b""")
def legacy_mode_words(spark, d):
    """Every error mode packed with an absolute bound, and read back."""
    rows = []
    for mode in metadata.MODE_NUMBERS:
        if "PW" in mode and mode != "PW_REL":
            continue
        words = metadata.legacy_error_words(mode, abs_=1e-3)
        back = metadata.read_legacy_error_words(words)
        if back["abs"] != 1e-3 or metadata.MODE_NUMBERS[back["mode"]] != words[0]:
            raise ValueError(f"the words of {mode} don't read back")
        rows.append((mode, words[0], f"0b{words[1]:032b}", f"0b{words[2]:032b}", len(words)))
    return spark.createDataFrame(rows, "mode string, number int, abs_high string, abs_low string, words long")


@query("SELECT i AS method, ['eb','psnr','ssim','cr'][i // 4 + 1] || '_' || ['eb','psnr','ssim','cr'][i % 4 + 1] AS goal FROM range(16) t(i)")
def method_names(spark, d):
    return spark.range(16).select(F.col("id").alias("method"), metadata.method_name(F.col("id")).alias("goal"))


@query("SELECT n AS length, CAST(CASE WHEN n < 8 THEN 0 ELSE least(6, floor(log2(n / 8)) + 1) END AS INTEGER) AS levels FROM unnest([7, 8, 16, 31, 64, 100, 1000]) t(n)")
def wavelet_levels(spark, d):
    return spark.createDataFrame([(n, bits.wavelet_levels(n)) for n in (7, 8, 16, 31, 64, 100, 1000)], "length int, levels int")


@query("SELECT b AS bits, CAST(b // 8 * 31 + CASE WHEN b % 8 = 0 THEN 0 ELSE (b % 8 * 31 - 1) // 8 + 1 END AS BIGINT) AS bytes, CAST(CASE WHEN b = 0 THEN 5 ELSE 9 + b // 8 * 31 + CASE WHEN b % 8 = 0 THEN 0 ELSE (b % 8 * 31 - 1) // 8 + 1 END END AS BIGINT) AS record FROM range(33) t(b)")
def saved_bit_bytes(spark, d):
    rows = spark.createDataFrame([(b, szp.record_bytes(32, b)) for b in range(33)], "bits long, record long")
    return rows.select("bits", bits.saved_bit_bytes(31, F.col("bits")).cast("long").alias("bytes"), "record")


@query("""SELECT d AS dims, CASE WHEN len(k) = 0 THEN '1' ELSE array_to_string(k, 'x') END AS kept, CAST(coalesce(list_product(k), 1) AS BIGINT) AS num,
  CASE WHEN len(k) = len(a) THEN 0 WHEN len(k) > 0 THEN 1 ELSE 2 END AS status
  FROM (SELECT d, a, list_filter(a, lambda x: x > 1) AS k FROM (SELECT unnest(['1x500x1x100', '500x500x100', '1', '1x1', '7']) AS d, list_transform(string_split(d, 'x'), lambda x: x::BIGINT) AS a))""")
def dims_normalised(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("1x500x1x100", "500x500x100", "1", "1x1", "7")], "dims string")
    own = F.transform(F.split("dims", "x"), lambda x: x.cast("long"))
    return rows.select("dims", F.array_join(metadata.normalise_dims(own), "x").alias("kept"), metadata.product(metadata.normalise_dims(own)).alias("num"), metadata.dims_status(own).alias("status"))


@query("""SELECT d AS dims, array_to_string(list_reverse(string_split(d, 'x')), 'x') AS turned, CAST(list_product(list_transform(string_split(d, 'x'), lambda x: x::BIGINT)) AS BIGINT) AS num
  FROM (SELECT unnest(['1x500x1x100', '500x500x100', '7', '2x3']) AS d)""")
def dims_reversed(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("1x500x1x100", "500x500x100", "7", "2x3")], "dims string")
    own = metadata.reverse_dims(F.transform(F.split("dims", "x"), lambda x: x.cast("long")))
    return rows.select("dims", F.array_join(own, "x").alias("turned"), metadata.product(own).alias("num"))


@query(with_sql("walk") + f""" SELECT idx, round(1 / (1 + exp(-{D} / 100)), 6) AS sigmoid, round(ln(p / (1 - p)), 4) AS logit, round(0.5 * ln((1 + t) / (1 - t)), 4) AS arctanh, round(tanh({D} / 1000), 6) AS tanh
  FROM (SELECT *, least(greatest(abs({D}) / 2000, 1e-7), 1 - 1e-7) AS p, least(greatest({D} / 2000, 1e-7 - 1), 1 - 1e-7) AS t FROM walk)""")
def transform_functions(spark, d):
    v = F.col("v").cast("double")
    return fixture(spark, d, "walk").cells.select("idx", F.round(bits.sigmoid(v / 100), 6).alias("sigmoid"), F.round(bits.logit(F.abs(v) / 2000), 4).alias("logit"), F.round(bits.arctanh(v / 2000), 4).alias("arctanh"), F.round(F.tanh(v / 1000), 6).alias("tanh"))


BITS = "CAST(CAST({0} AS BIT) AS VARCHAR)"
UINT = "CAST(CAST({0} AS BIT) AS UINTEGER)"


@query(with_sql("events") + f" SELECT idx, CAST({UINT.format('v')} AS BIGINT) AS raw, CAST(({UINT.format('v')} >> 23) & 255 AS INTEGER) - 127 AS exponent, CAST({UINT.format('v')} & 4294901760 AS BIGINT) AS kept FROM f_events")
def float_fields(spark, d):
    rows = fixture(spark, d, "events").cells
    raw = bits.float_bits(F.col("v"))
    return rows.select("idx", raw.cast("long").alias("raw"), bits.exponent(raw).alias("exponent"), bits.float_bits(bits.truncate_float(F.col("v"), 2)).cast("long").alias("kept"))


# --- estimators -------------------------------------------------------------------------------------------------------

OPTIONS = {"szx": {"stride": 3}, "cuszp": {"chunk": 256}, "sperr": {"block": 8, "rate": 0.5}, "sz3": {"stride": 3}}
REL = 0.001
EB = "eb AS (SELECT CAST(0.001 * CAST(max(v) - min(v) AS DOUBLE) AS FLOAT)::DOUBLE AS eb, CAST(max(v) - min(v) AS DOUBLE) AS rng, count(*) AS n FROM walk)"


def _est(spark, d, name: str, metric: str, field: str = "walk", rel: float = REL, **more):
    f = fixture(spark, d, field)
    options = {k: v for k, v in OPTIONS.get(name, {}).items()} | more
    return selection.estimate(f, name, f.bound(rel), metric, **options).select("codec", F.round("value", 6).alias("value"))


SZX = SZX_SAMPLE.format(view="walk") + f""", {EB},
  xb AS (SELECT block_id, min(v) AS low, CAST(CAST(max(v) - min(v) AS DOUBLE) / 2 AS FLOAT) AS radius FROM s GROUP BY ALL),
  xc AS (SELECT *, CAST(low + radius AS FLOAT) AS med, CAST(radius AS DOUBLE) <= eb AS con,
    greatest(9, 9 + (CAST(({UINT.format('radius')} >> 23) & 255 AS INTEGER) - 127) - (CAST((CAST(CAST(eb AS BIT) AS UBIGINT) >> 52) & 2047 AS INTEGER) - 1023) + 1) AS len0 FROM xb, eb),
  blk AS (SELECT block_id, radius, con, CASE WHEN len0 > 32 AND NOT con THEN 0.0::FLOAT ELSE med END AS med, (least(len0, 32) + 7) // 8 AS bytes, (8 - least(len0, 32) % 8) % 8 AS sh FROM xc),
  xv AS (SELECT block_id, pos, bytes, {UINT.format('CAST(v - med AS FLOAT)')} >> sh AS b FROM s JOIN blk USING (block_id) WHERE NOT con),
  xl AS (SELECT bytes, xor(b, coalesce(lag(b) OVER (PARTITION BY block_id ORDER BY pos), 0::UINTEGER)) AS x FROM xv),
  ld AS (SELECT coalesce(sum(least(CASE WHEN x >> 8 = 0 THEN 3 WHEN x >> 16 = 0 THEN 2 WHEN x >> 24 = 0 THEN 1 ELSE 0 END, bytes)), 0) AS lead_bytes FROM xl),
  cm AS (SELECT count(*) AS blocks, sum(con::INTEGER) AS constant_blocks, coalesce(sum(CASE WHEN NOT con THEN bytes END), 0) AS req_bytes FROM blk)"""


@query(with_sql("walk") + ", " + SZX + " SELECT CAST(blocks AS BIGINT) AS blocks, CAST(constant_blocks AS BIGINT) AS constant_blocks, CAST(req_bytes AS BIGINT) AS req_bytes, CAST(lead_bytes AS BIGINT) AS lead_bytes FROM cm, ld")
def szx_components(spark, d):
    f = fixture(spark, d, "walk")
    return szx.components(f, f.bound(REL), 3)


SZX_CR = """4 * 128 / (13.0 * 128 / n + 33 / 8 + (1 + (0.25 + CASE WHEN blocks > constant_blocks THEN req_bytes / (blocks - constant_blocks) ELSE 4 END) * 128
  - CASE WHEN blocks > constant_blocks THEN lead_bytes / (blocks - constant_blocks) ELSE 0 END) * (1 - constant_blocks / blocks))"""


@query(with_sql("walk") + ", " + SZX + f" SELECT 'szx' AS codec, round({SZX_CR}, 6) AS value FROM cm, ld, eb")
def szx_cr(spark, d):
    return _est(spark, d, "szx", "cr")


SZX_PSNR = "(SELECT -20*log10(sqrt(sum(CASE WHEN con THEN (CAST(v AS DOUBLE)-CAST(med AS DOUBLE))*(CAST(v AS DOUBLE)-CAST(med AS DOUBLE)) ELSE eb*eb END)/max(n))/max(rng) + 1e-16) FROM s JOIN blk USING (block_id), eb)"


@query(with_sql("walk") + ", " + SZX + f" SELECT 'szx' AS codec, round({SZX_PSNR}, 6) AS value")
def szx_psnr(spark, d):
    return _est(spark, d, "szx", "psnr")


SZX_LENGTH = f"greatest(9, 9 + (CAST(({UINT.format('radius')} >> 23) & 255 AS INTEGER) - 127) - (CAST((CAST(CAST(eb AS BIT) AS UBIGINT) >> 52) & 2047 AS INTEGER) - 1023) + 1)"


@query(with_sql("walk") + f""", {EB}, sb AS (SELECT (idx // 128) // 3 * 128 + idx % 128 AS idx, v FROM walk, eb WHERE idx // 128 < n // 128 AND (idx // 128) % 3 = 0),
  xb AS (SELECT idx // 128 AS block_id, min(v) AS low, CAST(CAST(max(v) - min(v) AS DOUBLE) / 2 AS FLOAT) AS radius FROM sb GROUP BY ALL),
  blk AS (SELECT block_id, CAST(low + radius AS FLOAT) AS med, CAST(radius AS DOUBLE) <= eb AS con, (8 - least({SZX_LENGTH}, 32) % 8) % 8 AS sh FROM xb, eb),
  pairs AS (SELECT idx, {D} AS x, CAST(CASE WHEN con THEN med ELSE CAST(CAST(CAST({UINT.format('v')} & (4294967295 - (4294967295::UBIGINT >> (23 - sh))) AS UINTEGER) AS BIT) AS FLOAT) END AS DOUBLE) AS y FROM sb JOIN blk ON block_id = idx // 128)"""
       + ssim_sql([("idx // 8", "true")]).replace("SELECT count(*) AS windows, round(avg(", "SELECT 'szx' AS codec, round(avg(").replace("AS ssim FROM k", "AS value FROM k"))
def szx_ssim(spark, d):
    return _est(spark, d, "szx", "ssim")


SZP = f"""{EB}, zs AS (SELECT idx // 32 AS block_id, idx % 32 AS pos, v FROM walk, eb WHERE idx // 32 >= n // 32 OR (idx // 32) % 5 = 0),
  zc AS (SELECT block_id, pos, CAST(trunc({D} * (1 / eb)) AS BIGINT) AS code FROM zs, eb),
  zd AS (SELECT block_id, abs(code - lag(code) OVER (PARTITION BY block_id ORDER BY pos)) AS step FROM zc),
  zb AS (SELECT block_id, count(*) AS cells, count(*) - 1 AS m, coalesce(max(step), 0) AS most FROM zd GROUP BY ALL),
  zw AS (SELECT *, CASE WHEN most = 0 THEN 0 ELSE len(bin(most)) END AS w FROM zb),
  zz AS (SELECT block_id, cells, CAST(5 + CASE WHEN most > 0 THEN (m + 7) // 8 + w // 8 * m + CASE WHEN w % 8 = 0 THEN 0 ELSE (w % 8 * m - 1) // 8 + 1 END ELSE 0 END AS BIGINT) AS bytes FROM zw)"""


@query(with_sql("walk") + ", " + SZP + " SELECT block_id, cells, bytes FROM zz")
def szp_block_bytes(spark, d):
    f = fixture(spark, d, "walk")
    return szp.block_sizes(of_bounds(szp.sampled(f, 5, 32), [f.bound(REL)])).select("block_id", "cells", "bytes")


SZP_CR = "(SELECT 4 * sum(cells - 1) / sum(bytes) FROM zz)"


@query(with_sql("walk") + ", " + SZP + f" SELECT 'szp' AS codec, round({SZP_CR}, 6) AS value")
def szp_cr(spark, d):
    return _est(spark, d, "szp", "cr")


HALF = "(trunc({0} * (0.5 / eb) + 0.5) - CASE WHEN {0} * (0.5 / eb) < -0.5 THEN 1 ELSE 0 END)".format(D)
SZP_PSNR = f"(SELECT -20*log10(sqrt(avg(({D} - {HALF}*2*eb)*({D} - {HALF}*2*eb)))/CAST(max(v)-min(v) AS DOUBLE) + 1e-16) FROM zs, eb WHERE pos > 0)"


@query(with_sql("walk") + ", " + SZP + f" SELECT 'szp' AS codec, round({SZP_PSNR}, 6) AS value")
def szp_psnr(spark, d):
    return _est(spark, d, "szp", "psnr")


@query(with_sql("walk") + f", {EB}, pairs AS (SELECT (idx // 32) // 5 * 32 + idx % 32 AS idx, {D} AS x, CASE WHEN idx % 32 = 0 THEN 0.0 ELSE CAST(CAST({HALF}*(2*eb) AS FLOAT) AS DOUBLE) END AS y FROM walk, eb WHERE idx // 32 < n // 32 AND (idx // 32) % 5 = 0)"
       + ssim_sql([("idx // 8", "true")]).replace("SELECT count(*) AS windows, round(avg(", "SELECT 'szp' AS codec, round(avg(").replace("AS ssim FROM k", "AS value FROM k"))
def szp_ssim(spark, d):
    return _est(spark, d, "szp", "ssim")


CUSZP = f"""{EB}, us AS (SELECT idx, v FROM walk, eb WHERE idx // 256 < n // 256 AND (idx // 256) % 5 = 0),
  ud AS (SELECT idx // 32 AS b, abs({HALF} - coalesce(lag({HALF}) OVER (PARTITION BY idx // 32 ORDER BY idx), 0)) AS step FROM us, eb),
  ub AS (SELECT b, count(*) AS cells, CAST(max(step) AS BIGINT) AS most FROM ud GROUP BY ALL)"""


@query(with_sql("walk") + ", " + CUSZP + " SELECT 'cuszp' AS codec, round(4 * sum(cells) / sum(CASE WHEN most = 0 THEN 1 ELSE (len(bin(most)) + 1) * 4 END), 6) AS value FROM ub")
def cuszp_cr(spark, d):
    return _est(spark, d, "cuszp", "cr")


UKEPT = f"{EB}, uk AS (SELECT idx, v FROM walk, eb WHERE idx // 256 < n // 256 AND (idx // 32) % 8 % 5 = 0)"


@query(with_sql("walk") + ", " + UKEPT + f" SELECT 'cuszp' AS codec, round(-20*log10(sqrt(avg(({D} - {HALF}*2*eb)*({D} - {HALF}*2*eb)))/CAST(max(v)-min(v) AS DOUBLE) + 1e-16), 6) AS value FROM uk, eb")
def cuszp_psnr(spark, d):
    return _est(spark, d, "cuszp", "psnr")


@query(with_sql("walk") + ", " + UKEPT + f", pairs AS (SELECT (idx // 256 * 2 + (idx // 32) % 8 // 5) * 32 + idx % 32 AS idx, {D} AS x, CAST(CAST({HALF}*(2*eb) AS FLOAT) AS DOUBLE) AS y FROM uk, eb)"
       + ssim_sql([("idx // 8", "true")]).replace("SELECT count(*) AS windows, round(avg(", "SELECT 'cuszp' AS codec, round(avg(").replace("AS ssim FROM k", "AS value FROM k"))
def cuszp_ssim(spark, d):
    return _est(spark, d, "cuszp", "ssim")


SZ3 = f"""{EB}, nt AS (SELECT idx, v, {NEAR} FROM walk),
  ip AS (SELECT idx, v, CASE WHEN idx >= 3 AND idx + 3 < n AND (idx - 3) % 6 = 0 THEN -m3/16 + 9*m1/16 + 9*p1/16 - p3/16 WHEN idx = 1 THEN 3*m1/8 + 6*p1/8 - p3/8
    WHEN idx = CASE WHEN n % 2 = 0 THEN n - 3 ELSE n - 2 END THEN -m3/8 + 6*m1/8 + 3*p1/8 WHEN n % 2 = 0 AND idx = n - 1 THEN 3*m5/8 - 10*m3/8 + 15*m1/8 END AS pred FROM nt, eb WHERE idx % 2 = 1),
  iq AS (SELECT idx, v, pred, {D} - pred AS diff, CAST(trunc(abs({D} - pred) / eb) + 1 AS BIGINT) // 2 AS steps, eb FROM ip, eb WHERE pred IS NOT NULL),
  ir AS (SELECT *, CAST(pred + 2 * (CASE WHEN diff < 0 THEN -steps ELSE steps END) * eb AS FLOAT) AS recon FROM iq),
  ic AS (SELECT idx, CASE WHEN steps < 32768 AND abs(CAST(recon AS DOUBLE) - {D}) <= eb THEN 32768 + CASE WHEN diff < 0 THEN -steps ELSE steps END ELSE 0 END AS code FROM ir)"""


@query(with_sql("walk") + ", " + SZ3 + " SELECT idx, CAST(code AS INTEGER) AS code FROM ic")
def sz3_codes(spark, d):
    from fieldloom.operators.surrogates import sz3

    f = fixture(spark, d, "walk")
    return sz3.codes(f, f.bound(REL), 3)


SZ3_CR = "(SELECT 32 / bits FROM e)"


@query(with_sql("walk") + ", " + SZ3 + ", " + ENTROPY.format(codes="ic") + f" SELECT 'sz3' AS codec, round({SZ3_CR}, 6) AS value")
def sz3_cr(spark, d):
    return _est(spark, d, "sz3", "cr")


def interpolated_sql(sample: int) -> str:
    """The prediction on a grid of m points, from the point's number i and its neighbours."""
    inner = f"(i - 3) % {2 * sample} = 0"
    return f"""CASE WHEN m < 5 THEN CASE WHEN i + 1 < m AND (i - 1) % {2 * sample} = 0 THEN m1/2 + p1/2 WHEN m % 2 = 0 AND i = m - 1 THEN CASE WHEN m < 4 THEN m1 ELSE -0.5*m3 + 1.5*m1 END END
    WHEN i >= 3 AND i + 3 < m AND {inner} THEN -m3/16 + 9*m1/16 + 9*p1/16 - p3/16 WHEN i = 1 THEN 3*m1/8 + 6*p1/8 - p3/8
    WHEN i = CASE WHEN m % 2 = 0 THEN m - 3 ELSE m - 2 END THEN -m3/8 + 6*m1/8 + 3*p1/8 WHEN m % 2 = 0 AND i = m - 1 THEN 3*m5/8 - 10*m3/8 + 15*m1/8 END"""


def near_sql(window: str) -> str:
    return ", ".join(f"CAST({'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER ({window}) AS DOUBLE) AS {'m' if k < 0 else 'p'}{abs(k)}" for k in (-5, -3, -1, 1, 3))


#: What follows from predictions (idx, v, pred): codes, and the errors that are left.
CODED = f"""iq AS (SELECT *, {D} - pred AS diff, CAST(trunc(abs({D} - pred) / eb) + 1 AS BIGINT) // 2 AS steps FROM ip, eb WHERE pred IS NOT NULL),
  ir AS (SELECT *, CAST(pred + 2 * (CASE WHEN diff < 0 THEN -steps ELSE steps END) * eb AS FLOAT) AS recon FROM iq),
  iz AS (SELECT *, steps < 32768 AND abs(CAST(recon AS DOUBLE) - {D}) <= eb AS holds FROM ir),
  ic AS (SELECT idx, CASE WHEN holds THEN 32768 + CASE WHEN diff < 0 THEN -steps ELSE steps END ELSE 0 END AS code FROM iz)"""

#: All levels over a line, and those of them that the walk from the coarsest on comes to before it holds over 5000 errors.
SZ3_WALK = f"""{EB}, lv AS (SELECT l, CAST(pow(2, l - 1) AS BIGINT) AS s FROM range(1, 60) t(l), eb WHERE pow(2, l - 1) < n),
  gr AS (SELECT l, idx, v, idx // s AS i, (n - 1) // s + 1 AS m, {near_sql('PARTITION BY l ORDER BY idx')} FROM walk, lv, eb WHERE idx % s = 0),
  ip AS (SELECT l, idx, v, {interpolated_sql(3)} AS pred FROM gr WHERE i % 2 = 1), {CODED},
  held AS (SELECT l, count(*) AS c FROM iz GROUP BY l), used AS (SELECT l FROM (SELECT l, coalesce(sum(c) OVER (ORDER BY l DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM held) WHERE before <= 5000),
  er AS (SELECT idx, CASE WHEN holds THEN CAST(recon AS DOUBLE) - {D} ELSE 0 END AS err FROM iz JOIN used USING (l))"""


@query(with_sql("walk") + f", {SZ3_WALK} SELECT 'sz3' AS codec, round(-20*log10(sqrt((SELECT avg(err * err) FROM er))/rng + 1e-16), 6) AS value FROM eb")
def sz3_psnr(spark, d):
    return _est(spark, d, "sz3", "psnr")


@query(with_sql("walk") + f""", {SZ3_WALK}, nr AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS k, err FROM er),
  sb AS (SELECT (idx // 32) // 3 * 32 + idx % 32 AS idx, v FROM walk, eb WHERE idx // 32 < n // 32 AND (idx // 32) % 3 = 0),
  pairs AS (SELECT idx, {D} AS x, {D} + err AS y FROM sb JOIN nr ON k = (idx * 7919) % (SELECT count(*) FROM nr))"""
       + ssim_sql([("idx // 8", "true")]).replace("SELECT count(*) AS windows, round(avg(", "SELECT 'sz3' AS codec, round(avg(").replace("AS ssim FROM k", "AS value FROM k"))
def sz3_ssim(spark, d):
    return _est(spark, d, "sz3", "ssim")


def finest_3d_sql(sample: int) -> str:
    """Predictions of the finest level's passes along the three axes."""
    out = []
    for axis in range(3):
        others = " AND ".join(f"c{o} % {sample if o < axis else 2 * sample} = 0" for o in range(3) if o != axis)
        lines = ", ".join(f"c{o}" for o in range(3) if o != axis)
        out.append(f"SELECT idx, v, c{axis} AS i, d{axis} AS m, {near_sql(f'PARTITION BY {lines} ORDER BY c{axis}')} FROM cube3d, shape3 WHERE {others}")
    return f"gr AS ({' UNION ALL '.join(out)}), ip AS (SELECT idx, v, {interpolated_sql(sample)} AS pred FROM gr WHERE i % 2 = 1)"


@query(with_sql("cube3d") + ", " + EB.replace("FROM walk", "FROM cube3d") + ", " + finest_3d_sql(3) + ", " + CODED + ", " + ENTROPY.format(codes="ic") + " SELECT 'sz3' AS codec, round(32 / bits, 6) AS value FROM e")
def sz3_cr_3d(spark, d):
    return _est(spark, d, "sz3", "cr", "cube3d")


@query()
def zfp_cr(spark, d):
    return _est(spark, d, "zfp", "cr")


@query()
def zfp_psnr(spark, d):
    return _est(spark, d, "zfp", "psnr", "emb2d")


@query()
def zfp_ssim(spark, d):
    return _est(spark, d, "zfp", "ssim", "cube3d")


@query()
def sperr_cr(spark, d):
    return _est(spark, d, "sperr", "cr", "cube3d")


@query()
def sperr_psnr(spark, d):
    return _est(spark, d, "sperr", "psnr", "emb2d")


@query()
def sperr_ssim(spark, d):
    return _est(spark, d, "sperr", "ssim", "cube3d")


# --- selection --------------------------------------------------------------------------------------------------------

NATIVE = ("szx", "szp", "sz3")


def _best(spark, d, metric: str, codecs=NATIVE):
    f = fixture(spark, d, "walk").keep()
    rows = selection.best(selection.estimates(f, codecs, f.bound(REL), metric, OPTIONS))
    return rows.select("field", "codec", F.round("value", 6).alias("value"))


PICK = "SELECT 'walk' AS field, codec, round(value, 6) AS value FROM ({0}) ORDER BY value DESC, r LIMIT 1"


@query(with_sql("walk") + ", " + SZX + ", " + SZP.replace(EB + ", ", "") + ", " + SZ3.replace(EB + ", ", "") + ", " + ENTROPY.format(codes="ic") + " "
       + PICK.format(f"SELECT 'sz3' AS codec, 0 AS r, {SZ3_CR} AS value UNION ALL SELECT 'szx', 1, (SELECT {SZX_CR} FROM cm, ld, eb) UNION ALL SELECT 'szp', 2, {SZP_CR}"))
def best_codec_cr(spark, d):
    return _best(spark, d, "cr")


@query(with_sql("walk") + ", " + SZX + ", " + SZP.replace(EB + ", ", "") + " " + PICK.format(f"SELECT 'szx' AS codec, 0 AS r, {SZX_PSNR} AS value UNION ALL SELECT 'szp', 1, {SZP_PSNR}"))
def best_codec_psnr(spark, d):
    return _best(spark, d, "psnr", ("szx", "szp"))


@query("SELECT 'walk' AS field, codec, value FROM (" + " UNION ALL ".join(f"SELECT codec, value, {r} AS r FROM ({ORACLES[n + '_ssim']})" for r, n in enumerate(("sz3", "szx", "szp"))) + ") ORDER BY value DESC, r LIMIT 1")
def best_codec_ssim(spark, d):
    return _best(spark, d, "ssim")


def sweep_sql(bounds: str) -> str:
    return with_sql("walk") + f""", bs AS ({bounds}), zs AS (SELECT idx // 32 AS block_id, idx % 32 AS pos, v FROM walk, (SELECT count(*) AS n FROM walk) WHERE idx // 32 >= n // 32 OR (idx // 32) % 5 = 0),
  zc AS (SELECT i, eb, block_id, pos, CAST(trunc({D} * (1 / eb)) AS BIGINT) AS code FROM zs, bs),
  zd AS (SELECT i, eb, block_id, abs(code - lag(code) OVER (PARTITION BY i, block_id ORDER BY pos)) AS step FROM zc),
  zb AS (SELECT i, eb, block_id, count(*) AS cells, count(*) - 1 AS m, coalesce(max(step), 0) AS most FROM zd GROUP BY ALL),
  zw AS (SELECT *, CASE WHEN most = 0 THEN 0 ELSE len(bin(most)) END AS w FROM zb)
  SELECT round(eb, 8) AS eb, round(4 * sum(cells - 1) / sum(5 + CASE WHEN most > 0 THEN (m + 7) // 8 + w // 8 * m + CASE WHEN w % 8 = 0 THEN 0 ELSE (w % 8 * m - 1) // 8 + 1 END ELSE 0 END), 6) AS value FROM zw GROUP BY i, eb"""


def _sweep(spark, d, bounds):
    rows = selection.sweep(fixture(spark, d, "walk"), ("szp",), bounds, "cr")
    return rows.select(F.round("eb", 8).alias("eb"), F.round("value", 6).alias("value"))


@query(sweep_sql("SELECT i, (i + 1) / 16 AS eb FROM range(16) t(i)"))
def eb_sweep_linear(spark, d):
    return _sweep(spark, d, [(i + 1) / 16 for i in range(16)])


@query(sweep_sql("SELECT i, pow(10.0::DOUBLE, -i / 3) AS eb FROM range(16) t(i)"))
def eb_sweep_log(spark, d):
    return _sweep(spark, d, [10 ** (-i / 3) for i in range(16)])


def _search(spark, d, goal: str, target: float, **more):
    f = fixture(spark, d, "walk")
    rows = selection.choose(f, goal, target, ("szx", "szp"), OPTIONS, **more)
    return rows.select("field", "codec", F.round(F.log10("eb"), 6).alias("log_eb"), "metric", F.round("value", 6).alias("value"))


def clamped(x: str) -> str:
    return f"CAST(greatest(least(trunc({x}), 4e18), -4e18) AS BIGINT)"


HALF_CLAMPED = f"({clamped(f'{D} * (0.5 / eb) + 0.5')} - CASE WHEN {D} * (0.5 / eb) < -0.5 THEN 1 ELSE 0 END)"

#: Every bound that a bisection can come to, and what both codecs' estimates say there.
GRID = with_sql("walk").replace("WITH", "WITH RECURSIVE", 1) + ", " + SZX_SAMPLE.format(view="walk") + f""",
  r0 AS (SELECT CAST(max(v) - min(v) AS DOUBLE) AS rng, count(*) AS n FROM walk),
  tree(lo, hi) AS (SELECT -16.0::DOUBLE, log10(rng) FROM r0 UNION ALL
    SELECT CASE side WHEN 0 THEN lo ELSE (lo + hi) / 2 END, CASE side WHEN 0 THEN (lo + hi) / 2 ELSE hi END FROM tree, (VALUES (0), (1)) t(side) WHERE hi - lo > 0.1),
  bs AS (SELECT (lo + hi) / 2 AS mid, pow(10.0::DOUBLE, (lo + hi) / 2) AS eb FROM tree WHERE hi - lo > 0.1),
  xb AS (SELECT block_id, min(v) AS low, CAST(CAST(max(v) - min(v) AS DOUBLE) / 2 AS FLOAT) AS radius FROM s GROUP BY ALL),
  xc AS (SELECT *, CAST(low + radius AS FLOAT) AS med, CAST(radius AS DOUBLE) <= eb AS con, {SZX_LENGTH} AS len0 FROM xb, bs),
  blk AS (SELECT mid, eb, block_id, con, CASE WHEN len0 > 32 AND NOT con THEN 0.0::FLOAT ELSE med END AS med, (least(len0, 32) + 7) // 8 AS bytes, (8 - least(len0, 32) % 8) % 8 AS sh FROM xc),
  xv AS (SELECT mid, block_id, pos, bytes, {UINT.format('CAST(v - med AS FLOAT)')} >> sh AS b FROM s JOIN blk USING (block_id) WHERE NOT con),
  xl AS (SELECT mid, bytes, xor(b, coalesce(lag(b) OVER (PARTITION BY mid, block_id ORDER BY pos), 0::UINTEGER)) AS x FROM xv),
  ld AS (SELECT mid, sum(least(CASE WHEN x >> 8 = 0 THEN 3 WHEN x >> 16 = 0 THEN 2 WHEN x >> 24 = 0 THEN 1 ELSE 0 END, bytes)) AS lead_bytes FROM xl GROUP BY mid),
  cm AS (SELECT mid, count(*) AS blocks, sum(con::INTEGER) AS constant_blocks, coalesce(sum(CASE WHEN NOT con THEN bytes END), 0) AS req_bytes, coalesce(any_value(lead_bytes), 0) AS lead_bytes FROM blk LEFT JOIN ld USING (mid) GROUP BY mid),
  zs AS (SELECT idx // 32 AS block_id, idx % 32 AS pos, v FROM walk, r0 WHERE idx // 32 >= n // 32 OR (idx // 32) % 5 = 0),
  zc AS (SELECT mid, block_id, pos, {clamped(f'{D} * (1 / eb)')} AS code FROM zs, bs),
  zd AS (SELECT mid, block_id, abs(code - lag(code) OVER (PARTITION BY mid, block_id ORDER BY pos)) AS step FROM zc),
  zb AS (SELECT mid, block_id, count(*) AS cells, count(*) - 1 AS m, coalesce(max(step), 0) AS most FROM zd GROUP BY ALL),
  zw AS (SELECT *, CASE WHEN most = 0 THEN 0 ELSE len(bin(most)) END AS w FROM zb),
  vals AS (SELECT 'szx' AS codec, 2 AS r, 'cr' AS metric, mid, {SZX_CR} AS value FROM cm, r0
    UNION ALL SELECT 'szx', 2, 'psnr', mid, -20*log10(sqrt(sum(CASE WHEN con THEN ({D}-CAST(med AS DOUBLE))*({D}-CAST(med AS DOUBLE)) ELSE eb*eb END)/max(n))/max(rng) + 1e-16) FROM s JOIN blk USING (block_id), r0 GROUP BY mid
    UNION ALL SELECT 'szp', 4, 'cr', mid, 4 * sum(cells - 1) / sum(5 + CASE WHEN most > 0 THEN (m + 7) // 8 + w // 8 * m + CASE WHEN w % 8 = 0 THEN 0 ELSE (w % 8 * m - 1) // 8 + 1 END ELSE 0 END) FROM zw GROUP BY mid
    UNION ALL SELECT 'szp', 4, 'psnr', mid, -20*log10(sqrt(avg(({D} - {HALF_CLAMPED}*(2*eb))*({D} - {HALF_CLAMPED}*(2*eb))))/CAST(max(v)-min(v) AS DOUBLE) + 1e-16) FROM zs, bs WHERE pos > 0 GROUP BY mid),
"""


def search_sql(fixed: str, target: float, pick: str) -> str:
    """The path of a bisection for a target, and the codec that pick (value, metric, order) prefers at its end."""
    goes_on = f"value < {target}" if fixed == "cr" else f"value > {target}"
    value, metric, order = pick.split("|")
    return GRID + f"""  path(codec, r, depth, lo, hi) AS (SELECT codec, r, 0, -16.0::DOUBLE, log10(rng) FROM (VALUES ('szx', 2), ('szp', 4)) t(codec, r), r0 UNION ALL
    SELECT p.codec, p.r, depth + 1, CASE WHEN {goes_on} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {goes_on} THEN hi ELSE (lo + hi) / 2 END
    FROM path p JOIN vals w ON w.codec = p.codec AND w.metric = '{fixed}' AND w.mid = (lo + hi) / 2 WHERE hi - lo > 0.1),
  ends AS (SELECT codec, r, (lo + hi) / 2 AS mid FROM path WHERE hi - lo > 0.1 QUALIFY row_number() OVER (PARTITION BY codec ORDER BY depth DESC) = 1),
  got AS (SELECT e.codec, e.r, e.mid, {value} AS value FROM ends e LEFT JOIN vals w ON w.codec = e.codec AND w.metric = '{metric}' AND w.mid = e.mid)
  SELECT 'walk' AS field, codec, round(mid, 6) AS log_eb, '{metric}' AS metric, round(value, 6) AS value FROM got ORDER BY value {order}, r LIMIT 1"""


@query(search_sql("cr", 4.0, "pow(10.0::DOUBLE, e.mid)|eb|ASC"))
def search_cr_eb(spark, d):
    return _search(spark, d, "cr_eb", 4.0)


@query(search_sql("psnr", 60.0, "value|cr|DESC"))
def search_psnr_cr(spark, d):
    return _search(spark, d, "psnr_cr", 60.0)


@query(search_sql("cr", 4.0, "value|psnr|DESC"))
def search_cr_psnr(spark, d):
    return _search(spark, d, "cr_psnr", 4.0)


@query()
def target_ratio_bounds(spark, d):
    """For nine target ratios, the bound found for a codec and the ratio that it really gets there."""
    f = fixture(spark, d, "walk").keep()
    targets = [1 + t / 10 for t in range(2, 11)]
    found = [(t, *probes[-1]) for t, probes in zip(targets, selection.find_bounds(f, "szp", "cr", targets, OPTIONS), strict=True)]
    asked = spark.createDataFrame(found, "target double, eb double, estimated double")
    return asked.join(selection.real_ratios(f, "szp", sorted({eb for _, eb, _ in found})), "eb").select("target", "eb", "estimated", F.col("ratio").alias("real"))


@query()
def eb_sweep_real(spark, d):
    """Estimated and real ratio under each of sixteen bounds."""
    f, bounds = fixture(spark, d, "walk").keep(), [10 ** (-i / 3) for i in range(16)]
    guessed = selection.estimate_all(f, "szp", bounds, "cr").select("eb", F.col("value").alias("estimated"))
    return guessed.join(selection.real_ratios(f, "szp", bounds), "eb").select(F.round("eb", 8).alias("eb"), F.round("estimated", 6).alias("estimated"), F.round("ratio", 6).alias("real"))


@query()
def tuned_levels(spark, d):
    """The best levels of the interpolation codec for each tuning target."""
    f = fixture(spark, d, "walk").keep()
    return selection.best_levels(f, f.bound(REL), every=2, cells=500)


@query()
def autotuned_bound(spark, d):
    f = fixture(spark, d, "walk").keep()
    eb, value = selection.autotune(f, "szp", "cr", 3.0, 0.02, 24)
    return spark.createDataFrame([(eb, value)], "eb double, cr double")


# --- codecs -----------------------------------------------------------------------------------------------------------


@query()
def compress_chunks(spark, d):
    f = fixture(spark, d, "cube3d")
    return selection.compress(f, "sz3", f.bound(REL), cells=2000).select("field", "chunk_id", "codec", "eb", "method_id", "dtype", "dims", "start", "payload_bytes")


@query(with_sql("cube3d") + """ SELECT 'cube3d' AS field, 'trunc' AS codec, c AS chunk_id, c * m AS start, least(m, n - c * m) AS cells, 3 AS method_id
  FROM (SELECT d1 * d2 * greatest(1, 2000 // (d1 * d2)) AS m, d0 * d1 * d2 AS n FROM shape3), range(0, 100000) t(c) WHERE c * m < n""")
def stream_header(spark, d):
    f = fixture(spark, d, "cube3d")
    return selection.chunk_table(selection.compress(f, "trunc", 0.0, cells=2000)).select("field", "codec", "chunk_id", "start", "cells", "method_id")


@query(with_sql("cube3d") + " SELECT idx, v FROM cube3d WHERE idx >= 300 AND idx < 700")
def decompress_part(spark, d):
    f = fixture(spark, d, "cube3d")
    return selection.decompress_range(selection.compress(f, "trunc", 0.0, cells=200), 300, 700)


@query(with_sql("cube3d") + " SELECT idx, true AS within_bound FROM cube3d")
def decompress_chunks(spark, d):
    f = fixture(spark, d, "cube3d")
    eb = f.bound(REL)
    back = selection.decompress(selection.compress(f, "sz3", eb, cells=2000))
    return stats.zipped(f.cells, back).select("idx", (F.abs(F.col("x") - F.col("y")) <= eb).alias("within_bound"))


def _round_trips(spark, d, name: str, rank: int):
    f = fixture(spark, d, name)
    eb = f.bound(REL)
    back = selection.decompress(selection.compress(f, list(CODECS), eb), with_codec=True)
    pairs_ = f.cells.select("idx", F.col("v").cast("double").alias("x")).join(back.select("idx", "codec", F.col("v").cast("double").alias("y")), "idx")
    return pairs_.groupBy("codec").agg(F.count("*").alias("cells"), (F.max(F.abs(F.col("x") - F.col("y"))) <= eb).alias("within_bound"))


TRIPS = " SELECT codec, count(*) AS cells, true AS within_bound FROM {0}, unnest(['sz3', 'zfp', 'szx', 'sperr', 'szp', 'qoz', 'trunc']) t(codec) GROUP BY ALL"


@query(with_sql("cube3d") + " SELECT algorithm, count(*) AS cells, true AS within_bound FROM cube3d, unnest(['LORENZO_REG', 'INTERP', 'INTERP_LORENZO']) t(algorithm) GROUP BY ALL")
def algorithms_3d(spark, d):
    f = fixture(spark, d, "cube3d")
    eb = f.bound(REL)
    back = selection.decompress(selection.compress(f, list(ALGORITHMS), eb), with_codec=True).select("idx", F.col("codec").alias("algorithm"), F.col("v").cast("double").alias("y"))
    pairs_ = f.cells.select("idx", F.col("v").cast("double").alias("x")).join(back, "idx")
    return pairs_.groupBy("algorithm").agg(F.count("*").alias("cells"), (F.max(F.abs(F.col("x") - F.col("y"))) <= eb).alias("within_bound"))


@query("SELECT unnest(['bits', 'bits', 'psnr', 'psnr']) AS kind, unnest([2.0, 6.0, 40.0, 60.0]::DOUBLE[]) AS target, true AS met")
def wavelet_targets(spark, d):
    """Whether blocks of a field meet targets of bits a value and of signal to noise."""
    import pyarrow as pa

    from fieldloom.operators.codecs import wavelet

    f = fixture(spark, d, "cube3d")
    members = sampling.sperr_members(f.with_coords(), f.dims, 8).withColumn("block_id", F.col("block_id").cast("long"))

    def run(key, table):
        a = table.sort_by("pos").column("v").to_numpy().reshape(9, 9, 9)
        spread, rows, steps = float(np.ptp(a)), [], wavelet.Steps(a)
        for target in (2.0, 6.0):
            rows.append(("bits", target, 8 * len(wavelet.encode_target(a, bits_per_value=target, steps=steps)) <= target * a.size))
        for target in (40.0, 60.0):
            off = wavelet.decode(wavelet.encode_target(a, psnr=target, steps=steps)).astype(float) - a
            rows.append(("psnr", target, not off.any() or 10 * np.log10(spread**2 / (off**2).mean()) >= target))
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("kind", "target", "met"), zip(*rows), (pa.string(), pa.float64(), pa.bool_()))})

    return members.groupBy("block_id").applyInArrow(run, "kind string, target double, met boolean").groupBy("kind", "target").agg(F.every("met").alias("met"))


@query(with_sql("walk") + TRIPS.format("walk"))
def round_trip_1d(spark, d):
    return _round_trips(spark, d, "walk", 1)


@query(with_sql("emb2d") + TRIPS.format("emb2d"))
def round_trip_2d(spark, d):
    return _round_trips(spark, d, "emb2d", 2)


@query(with_sql("cube3d") + TRIPS.format("cube3d"))
def round_trip_3d(spark, d):
    return _round_trips(spark, d, "cube3d", 3)


# --- more of the kit --------------------------------------------------------------------------------------------------


@query(with_sql("walk") + f""", n AS (SELECT idx, v, lag(v) OVER (ORDER BY idx) AS b FROM walk), x AS (SELECT idx, xor({UINT.format('v')}, {UINT.format('b')}) AS x, CAST({BITS.format('v')} AS VARCHAR) AS bit_string FROM n WHERE b IS NOT NULL)
  SELECT idx, CAST(CASE WHEN x = 0 THEN 4 WHEN x >> 8 = 0 THEN 3 WHEN x >> 16 = 0 THEN 2 WHEN x >> 24 = 0 THEN 1 ELSE 0 END AS INTEGER) AS shared, bit_string, true AS restored FROM x""")
def shared_bytes(spark, d):
    near = shifted(fixture(spark, d, "walk").cells, {"b": ("v", -1)}).where("b is not null")
    n = kit.shared_leading_bytes(F.col("b"), F.col("v"))
    rows = near.withColumn("shared", n).withColumn("rest", kit.strip_shared(F.col("b"), F.col("v")))
    return rows.select("idx", "shared", kit.bit_string(F.col("v")).alias("bit_string"), (kit.join_shared(F.col("b"), F.col("rest"), F.col("shared")) == F.col("v")).alias("restored"))


@query(with_sql("emb2d") + """, n AS (SELECT idx, c0, c1, """ + ", ".join(f"CAST({'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER (PARTITION BY c{1 - a} ORDER BY c{a}) AS DOUBLE) AS {'m' if k < 0 else 'p'}{abs(k)}_{a}" for a in (0, 1) for k in (-3, -1, 1, 3)) + """ FROM emb2d)
  SELECT idx, round(((m1_0 + p1_0) / 2 + (m1_1 + p1_1) / 2) / 2, 5) + 0.0 AS linear2, round(((-m3_0 + 9*m1_0 + 9*p1_0 - p3_0) / 16 + (-m3_1 + 9*m1_1 + 9*p1_1 - p3_1) / 16) / 2, 5) + 0.0 AS cubic2 FROM n""")
def interp_cross(spark, d):
    from fieldloom.operators.windows import along

    rows, names = fixture(spark, d, "emb2d").with_coords(), [{}, {}]
    for a in (0, 1):
        for k in (-3, -1, 1, 3):
            name = f"{'m' if k < 0 else 'p'}{abs(k)}"
            names[a][name] = F.col(f"{name}_{a}")
            move = F.lag("v", -k) if k < 0 else F.lead("v", k)
            rows = rows.withColumn(f"{name}_{a}", move.over(along(a, 2)).cast("double"))
    return rows.select("idx", (F.round(predict.interpolate_cross("linear", names), 5) + 0.0).alias("linear2"), (F.round(predict.interpolate_cross("cubic", names), 5) + 0.0).alias("cubic2"))


@query(with_sql("walk") + f""", n AS (SELECT idx, {NEAR} FROM walk), s AS (SELECT *, m1 - m3 AS l, p1 - m1 AS c, p3 - p1 AS r FROM n),
  w AS (SELECT *, abs(c - l) AS a, abs(r - c) AS b FROM s)
  SELECT idx, round((m1 + p1) / 2 + (CASE WHEN a + b = 0 THEN (l + c) / 2 ELSE (b * l + a * c) / (a + b) END - CASE WHEN a + b = 0 THEN (c + r) / 2 ELSE (b * c + a * r) / (a + b) END) / 8, 4) AS akima FROM w""")
def interp_akima(spark, d):
    names = {n: ("v", k) for n, k in (("m3", -3), ("m1", -1), ("p1", 1), ("p3", 3))}
    near = shifted(fixture(spark, d, "walk").cells, names)
    return near.select("idx", F.round(predict.akima(*(F.col(n).cast("double") for n in names)), 4).alias("akima"))


def quadratic_weights(edge: int) -> str:
    """(h, p0, p1, term, w): what a cell at (p0, p1) of a block of h lines adds to a term's least-squares coefficient."""
    rows = []
    for h in range(1, edge + 1):
        at = np.indices((h, edge)).reshape(2, -1).T
        design = np.stack([at[:, 0] ** a * at[:, 1] ** b for a, b in predict.polynomial_terms(2)], axis=1).astype(float)
        for term, weights in enumerate(np.linalg.pinv(design)):
            rows += [f"({h}, {x}, {y}, {term}, {w!r}::DOUBLE)" for (x, y), w in zip(at.tolist(), weights.tolist(), strict=True)]
    return f"qw(h, p0, p1, term, w) AS (VALUES {', '.join(rows)})"


@query(with_sql("emb2d") + ", " + quadratic_weights(8) + f""", qh AS (SELECT c0 // 8 AS b0, c1 // 8 AS b1, max(c0 % 8) + 1 AS h FROM emb2d GROUP BY ALL)
  SELECT CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, CAST(term AS INTEGER) AS term, round(sum({D} * w), 4) + 0.0 AS coefficient
  FROM emb2d JOIN qh ON b0 = c0 // 8 AND b1 = c1 // 8 JOIN qw ON qw.h = qh.h AND p0 = c0 % 8 AND p1 = c1 % 8 GROUP BY ALL""")
def quadratic_block_coeffs(spark, d):
    f = fixture(spark, d, "emb2d")
    found = predict.quadratic_blocks(f.with_coords(), f.dims, 8)
    return found.withColumn("coefficient", F.round("coefficient", 4) + 0.0)


@query("SELECT l AS level, round(CASE WHEN l >= 3 THEN 0.005 ELSE 0.01 END, 8) AS by_ratio, round(0.01 / least(pow(1.5, l - 1), 4.0), 8) AS by_power, round(0.01 * greatest(1 - (l - 1) * 0.2, 0.1), 8) AS by_share FROM range(1, 9) t(l)")
def level_bounds(spark, d):
    rows = [(l, bits.level_bound(0.01, l), bits.level_bound(0.01, l, 1.5, 4.0), bits.level_bound(0.01, l, 0.2, 0.1)) for l in range(1, 9)]
    return spark.createDataFrame(rows, "level long, by_ratio double, by_power double, by_share double").select("level", *[F.round(c, 8).alias(c) for c in ("by_ratio", "by_power", "by_share")])


@query(with_sql("walk") + ", " + pairs_sql("walk") + """, fix AS (SELECT idx, x - y AS err FROM pairs WHERE abs(x - y) > 0.03) SELECT p.idx, round(y + coalesce(err, 0), 6) AS v FROM pairs p LEFT JOIN fix USING (idx)""")
def outlier_fix(spark, d):
    """Sparse corrections on a dense reconstruction."""
    p = pairs(fixture(spark, d, "walk"))
    fix = p.where(F.abs(F.col("x") - F.col("y")) > 0.03).select("idx", (F.col("x") - F.col("y")).alias("err"))
    return p.join(fix, "idx", "left").select("idx", F.round(F.col("y") + F.coalesce("err", F.lit(0.0)), 6).alias("v"))


@query()
def cdf97_energy(spark, d):
    """How much of each wavelet block's energy its low band keeps."""
    import pyarrow as pa

    from fieldloom.operators.codecs import wavelet

    f = fixture(spark, d, "cube3d")
    members = sampling.sperr_members(f.with_coords(), f.dims, 8).withColumn("block_id", F.col("block_id").cast("long"))

    def run(key, table):
        a = table.sort_by("pos").column("v").to_numpy().reshape(9, 9, 9)
        c = wavelet.dwt(a - a.mean())
        whole = float((c**2).sum())
        return pa.table({"block_id": [key[0].as_py()], "low_share": [float((c[:5, :5, :5] ** 2).sum()) / whole if whole else 1.0], "inverts": [bool(np.allclose(wavelet.idwt(c), a - a.mean(), atol=1e-6 * max(1.0, abs(a).max())))]})

    return members.groupBy("block_id").applyInArrow(run, "block_id long, low_share double, inverts boolean")


@query()
def search_ssim_cr(spark, d):
    f = fixture(spark, d, "walk")
    return selection.choose(f, "ssim_cr", 0.99, ("szx", "szp"), OPTIONS).select("field", "codec", "metric", F.round("value", 6).alias("value"))

