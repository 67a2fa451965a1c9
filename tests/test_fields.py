"""Fields, estimators, codecs and sources: goldens, properties and round trips."""

from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from fieldloom.functions import bits, kit, metadata
from fieldloom.operators import legacy, sampling, selection, stats
from fieldloom.operators.codecs import ALGORITHMS, CODECS, arithmetic, codec, lorenzo, multilevel, packing, transform, wavelet
from fieldloom.operators.surrogates import szp, szx
from fieldloom.plans import catalog
from fieldloom.sources import config, raw
from fieldloom.sources.fixtures import Field, fixture

SMALL = "/root/testdata/sf0.001"


def field_of(spark, values: np.ndarray, name: str = "f") -> Field:
    import pandas as pd

    flat = values.astype("f4").ravel()
    return Field(name, spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(flat)), "v": flat})).repartition(3), values.shape)


def test_words_and_shapes():
    assert metadata.cd_values(1e-4, 3) == (3944497965, 1058682594, 65539)
    assert metadata.double_words(1e-3) == (1062232653, 3539053052)
    packed = metadata.pack_config(1e-4, 3, "float", (500, 500, 100))
    assert metadata.unpack_config(packed) == {"eb": 1e-4, "method": 3, "dtype": "float", "dims": [500, 500, 100], "bit_width": 9}
    assert metadata.read_legacy_error_words(metadata.legacy_error_words("REL", rel=0.25)) == {"mode": "REL", "abs": 0.0, "rel": 0.25, "pw_rel": 0.0, "psnr": 0.0, "ratio": 0.0}
    for dims in ([7], [5, 6], [1 << 40], [2, 3, 4, 5, 6]):
        assert metadata.read_legacy_cd_values(metadata.legacy_cd_values(dims, "int32")) == (dims, "int32")
    assert metadata.h5repack_words("ABS", 1e-3) == [0, 1062232653, 3539053052, 0, 0, 0, 0, 0, 0]
    assert metadata.h5repack_words("REL", 1e-4) == [1, 0, 0, 1058682594, 3944497965, 0, 0, 0, 0]
    assert [metadata.h5repack_words(m, 1.0)[0] for m in ("PSNR", "PW_REL")] == [4, 10]
    numbers = {"ABS": 0, "REL": 1, "VR_REL": 1, "ABS_AND_REL": 2, "ABS_OR_REL": 3, "PSNR": 4, "NORM": 5, "FIX_RATE": 6, "PW_REL": 10}
    assert {m: metadata.legacy_error_words(m)[0] for m in numbers} == numbers
    assert metadata.read_legacy_error_words([10, *[0] * 10])["mode"] == "PW_REL"
    assert metadata.read_chunk_header(metadata.chunk_header(7, 3, 0.5)) == (7, 3, 0.5)
    assert [bits.wavelet_levels(n) for n in (7, 8, 16, 64, 1000)] == [0, 1, 2, 4, 6]
    assert bits.interpolation_levels((25, 20, 20)) == 5
    assert [szp.record_bytes(32, w) for w in (0, 1, 8)] == [5, 13, 40]
    assert metadata.method_of("eb_cr") == 3 and metadata.method_of("cr_psnr") == 13
    with pytest.raises(ValueError, match="no goal"):
        metadata.cd_values(1e-4, 0)


def test_constant_field(spark):
    f = fixture(spark, SMALL, "const")
    assert math.isclose(szx.cr(f, 0.1, 1).first()["value"], 512 / (1664 / 1024 + 4.125))


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(sorted(CODECS)), st.integers(0, 2**32), st.sampled_from([(57,), (1,), (300,), (9, 13), (4, 4), (6, 5, 7), (1, 8, 1)]), st.sampled_from([1e-1, 1e-3, 1e-6]), st.sampled_from(["noise", "walk", "huge", "tiny", "steps"]))
def test_codecs_hold_their_bound(name, seed, shape, rel, kind):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape)
    a = {"noise": a, "walk": a.cumsum(axis=-1), "huge": a * 1e30, "tiny": a * 1e-30, "steps": np.round(a)}[kind].astype("f4")
    eb = float(np.float32(rel * max(float(a.max()) - float(a.min()), 1e-30)))
    back = CODECS[name].decode(CODECS[name].encode(a, eb))
    assert back.shape == a.shape and back.dtype == np.float32
    assert np.abs(back.astype(float) - a.astype(float)).max() <= eb
    a.flat[seed % a.size] = (np.nan, np.inf, -np.inf)[seed % 3]
    assert np.array_equal(CODECS[name].decode(CODECS[name].encode(a, eb)), a, equal_nan=True)


@pytest.mark.parametrize("shape", [(500,), (40, 30), (12, 14, 10)])
def test_algorithms_and_levels(shape):
    a = np.random.default_rng(3).normal(size=shape).cumsum(axis=-1).astype("f4")
    for name in ALGORITHMS:
        assert np.abs(codec(name).decode(codec(name).encode(a, 1e-2)).astype(float) - a.astype(float)).max() <= 1e-2
    assert len(codec("INTERP_LORENZO").encode(a, 1e-2)) == 1 + min(len(CODECS[n].encode(a, 1e-2)) for n in ("sz3", "qoz"))
    flat = np.zeros(shape, "f4")
    flat.flat[np.random.default_rng(5).random(flat.size) < 0.05] = 1
    assert set(packing.unsqueeze(packing.unpack(lorenzo.encode(flat, 0.1))[3])) >= {lorenzo.ZERO}  # where nothing is near, nothing predicts best
    for alpha, beta, linear in ((1.0, 1.0, True), (1.5, 3.0, False), (2.0, 2.0, True)):
        assert np.abs(multilevel.decode(multilevel.encode(a, 1e-2, alpha, beta, linear)).astype(float) - a.astype(float)).max() <= 1e-2


def test_wavelet_targets():
    a = np.random.default_rng(4).normal(size=(24, 20, 20)).cumsum(axis=0).astype("f4")
    spread = float(a.max() - a.min())
    for bits in (1.0, 3.0):
        data = wavelet.encode_target(a, bits_per_value=bits)
        assert 0.7 * bits * a.size <= 8 * len(data) <= bits * a.size
    for psnr in (40.0, 70.0):
        back = wavelet.decode(wavelet.encode_target(a, psnr=psnr))
        assert psnr <= 10 * math.log10(spread**2 / ((back.astype(float) - a) ** 2).mean()) <= psnr + 3
    assert np.array_equal(wavelet.decode(wavelet.encode_target(np.ones((9, 9)), psnr=50.0)), np.ones((9, 9)))
    with pytest.raises(ValueError, match="one target"):
        wavelet.encode_target(a)


def plain_partition(magnitude: np.ndarray, planes: int) -> list[int]:
    """The bits of set partitioning, box by box."""
    out, sets, known = [], [tuple((0, d) for d in magnitude.shape)], []
    for plane in range(planes - 1, -1, -1):
        old, waiting, todo = len(known), [], sets[::-1]
        while todo:
            box = todo.pop()
            hit = int(magnitude[tuple(slice(a, b) for a, b in box)].max() >> plane > 0)
            out.append(hit)
            if not hit:
                waiting.append(box)
            elif all(b - a == 1 for a, b in box):
                known.append(tuple(a for a, _ in box))
            else:
                todo += wavelet.split(box)[::-1]
        out += [int(magnitude[cell]) >> plane & 1 for cell in known[:old]]
        sets = waiting
    return out


@pytest.mark.parametrize("shape", [(1,), (37,), (9, 9, 9), (5, 16), (1, 6, 1)])
def test_set_partition_by_hand(shape):
    rng = np.random.default_rng(sum(shape))
    for top in (0, 1, 9, 40, 60):
        a = (rng.random(shape) ** 9 * 2.0**top).astype(np.int64)
        a.flat[0] = (1 << top) - 1
        bits, planes = packing.Bits(), int(a.max()).bit_length()
        wavelet.set_partition(a, shape, planes, bits)
        assert bits.bits == plain_partition(a, planes)
        assert np.array_equal(wavelet.set_partition(None, shape, planes, bits), a)


def test_wavelet_targets_search_without_decoding(monkeypatch):
    a = np.random.default_rng(6).normal(size=(9, 9, 9)).cumsum(axis=0).astype("f4")
    apart, calls = [wavelet.encode_target(a, psnr=p) for p in (40.0, 60.0)], []
    coder = wavelet.set_partition
    monkeypatch.setattr(wavelet, "set_partition", lambda *args: calls.append(1) or coder(*args))
    steps = wavelet.Steps(a)
    assert [wavelet.encode_target(a, psnr=p, steps=steps) for p in (40.0, 60.0)] == apart
    assert len(calls) == 2  # what is found is coded, and nothing else


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31), max_size=400))
def test_huffman_round_trip(values):
    data = np.array(values, np.int64)
    assert packing.huffman_decode(packing.huffman_encode(data)).tolist() == values
    assert arithmetic.decode(arithmetic.encode(data)).tolist() == values
    assert kit.unpack_flags(kit.pack_flags(data > 0), len(data)).tolist() == (data > 0).tolist()
    assert kit.from_bytes(kit.to_bytes(data), "i8").tolist() == values


def test_finest_steps():
    c = np.random.default_rng(0).normal(size=1000)
    step = kit.finest_step_psnr(c, 60.0, float(np.ptp(c)))
    rmse = np.sqrt(np.mean((c - step * np.rint(c / step)) ** 2))
    assert rmse <= np.ptp(c) * 1e-3 and kit.finest_step_pwe(2.0) == 3.0 and kit.mask_code(5) == 31


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(16,), (33,), (17, 20), (9, 9, 9), (7, 40)]))
def test_wavelet_and_lifting_invert(seed, shape):
    a = np.random.default_rng(seed).normal(size=shape) * 100
    assert np.allclose(wavelet.idwt(wavelet.dwt(a)), a)
    b = np.random.default_rng(seed).integers(-(2**28), 2**28, (4, 4, 4))
    c = b.copy()
    for axis in range(3):
        transform.lift(c, axis)
    for axis in reversed(range(3)):
        transform.unlift(c, axis)
    assert np.abs(c - b).max() <= 64  # halvings drop low bits


def test_compress_and_decompress(spark):
    values = np.fromfunction(lambda i, j, k: np.sin(i / 4) + np.cos(j / 5) * k / 9, (20, 12, 10))
    f = field_of(spark, values)
    for name in CODECS:
        chunks = selection.compress(f, name, 1e-2, cells=500)
        assert chunks.count() == 5
        rows = stats.zipped(f.cells, selection.decompress(chunks)).selectExpr("count(*)", "max(abs(x - y))").first()
        assert rows[0] == values.size and rows[1] <= 1e-2
    with pytest.raises(ValueError, match="no codec"):
        selection.codec("none")


def test_choose(spark):
    f = fixture(spark, SMALL, "walk")
    row = selection.choose(f, "eb_cr", f.bound(1e-3), ("szx", "szp"), catalog.OPTIONS).first()
    each = {r["codec"]: r["value"] for r in selection.estimates(f, ("szx", "szp"), f.bound(1e-3), "cr", catalog.OPTIONS).collect()}
    assert row["value"] == max(each.values()) and each[row["codec"]] == row["value"]
    small, large = (selection.choose(f, "cr_eb", 3.0, ("szx", "szp"), catalog.OPTIONS, prefer=p).first()["eb"] for p in ("small", "large"))
    assert small <= large
    with pytest.raises(ValueError, match="no goal"):
        selection.choose(f, "cr_cr", 1.0)


def test_search_brackets_the_target():
    probes = selection.search(lambda eb: 2 + math.log10(eb), 1.0, True, 490.0)
    assert len(probes) == 8 and abs(math.log10(probes[-1][0]) + 1) < 0.3
    assert selection.search(lambda eb: 0.0, 1.0, True, 0.0) == []


def test_estimated_quality_falls_with_the_bound(spark):
    f = fixture(spark, SMALL, "walk").keep()
    found = [selection.estimate(f, "szp", f.bound(rel), "psnr").first()["value"] for rel in (1e-2, 1e-3, 1e-4)]
    assert found == sorted(found)


def test_raw_files(spark, tmp_path):
    values = np.arange(6000, dtype="<f4").reshape(60, 100) / 7
    (tmp_path / "a.bin").write_bytes(values.tobytes())
    f = raw.read_raw(spark, str(tmp_path / "a.bin"), "float", (60, 100))
    got = np.array([r["v"] for r in f.cells.orderBy("idx").collect()], "f4")
    assert np.array_equal(got, values.ravel())
    raw.write_raw(f, str(tmp_path / "b.bin"))
    assert (tmp_path / "b.bin").read_bytes() == values.tobytes()
    for dtype, kind in raw.KINDS.items():
        (tmp_path / f"{dtype}.bin").write_bytes(np.arange(30).astype(">" + kind).tobytes())
        g = raw.read_raw(spark, str(tmp_path / f"{dtype}.bin"), dtype, big_endian=True)
        assert [r["v"] for r in g.cells.orderBy("idx").collect()] == list(range(30))
        edge = np.array([np.iinfo(kind).max - 1, np.iinfo(kind).min] if kind[0] in "iu" else [2**24 + 1, 0.1 if kind == "f8" else 0.5], kind)
        (tmp_path / f"{dtype}.edge").write_bytes(edge.tobytes())
        g = raw.read_raw(spark, str(tmp_path / f"{dtype}.edge"), dtype)
        assert [r["v"] for r in g.cells.orderBy("idx").collect()] == edge.tolist()
        raw.write_raw(g, str(tmp_path / f"{dtype}.back"))
        assert (tmp_path / f"{dtype}.back").read_bytes() == edge.tobytes()
    (tmp_path / "prime.bin").write_bytes(np.arange(104729, dtype="<f8").tobytes())
    g = raw.read_raw(spark, str(tmp_path / "prime.bin"), "double")
    assert g.cells.where("v = idx").count() == 104729 and g.range == 104728
    with pytest.raises(Exception, match="bound"):
        selection.compress(Field("d", spark.createDataFrame([(0, 1e9 + 0.1)], "idx long, v double"), (1,), "double"), "sz3", 1e-3).count()
    wide = Field("d", spark.createDataFrame([(i, 1e3 + i / 7) for i in range(500)], "idx long, v double"), (500,), "double")
    assert stats.zipped(wide.cells, selection.decompress(selection.compress(wide, "sz3", 1e-3))).selectExpr("max(abs(x - y))").first()[0] <= 1e-3
    with pytest.raises(ValueError, match="bytes"):
        raw.read_raw(spark, str(tmp_path / "a.bin"), "float", (61, 100))
    chunks = selection.compress(f, "szx", 1e-3)
    raw.write_chunks(chunks, str(tmp_path / "chunks"))
    assert selection.decompress(raw.read_chunks(spark, str(tmp_path / "chunks"), "raw")).count() == 6000
    raw.write_text(f, str(tmp_path / "text"))
    raw.write_csv(f.cells.limit(3), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "text")).count() == 6000 and spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def test_settings_and_legacy(spark):
    assert config.load_config() == config.Settings()
    text = "[GlobalSettings]\nCompressorID = SZX\nCompressionMode = REL\n#a note\nAbsErrorBound = 0.001\nRelErrorBound = 1e-3\nPrecision = 2\nFixedCompressionRate = 0.6\nodd = 1\n"
    text += "[SECRESettings]\nUseSECRE = 1\nSECREMetric = SSIM\nSECRETarget = 0.95\nSECRETolerance = 0.01 # a share\n"
    s = config.load_config(text=text)
    assert s.setting == config.Setting("SZX", "REL", 0.001, 1e-3, 2, 0.6) and s.target == config.Target("ssim", True, 0.95, 0.01) and s.unknown == ("GlobalSettings.odd",)
    with pytest.raises(ValueError, match="none of"):
        config.load_config(text="[GlobalSettings]\nCompressorID = LZ4\n")
    with pytest.raises(ValueError, match="no codec"):
        legacy.legacy_compress(field_of(spark, np.arange(50.0)), config.Settings(config.Setting("DR")))
    rate = config.Setting("SZX", "FIX_RATE", rate=6.0)
    fixed = field_of(spark, np.random.default_rng(1).normal(size=4096).cumsum())
    assert abs(selection.estimate(fixed, "szx", legacy.absolute_bound(rate, fixed), "cr").first()["value"] / 6 - 1) < 0.5
    f = fixture(spark, SMALL, "part")
    plain = config.Settings(setting=s.setting)
    back = stats.zipped(f.cells, legacy.legacy_decompress(legacy.legacy_compress(f, plain))).selectExpr("max(abs(x - y))").first()[0]
    assert back <= 1e-3 * f.range
    tiny = field_of(spark, np.arange(5.0))
    assert stats.zipped(tiny.cells, legacy.legacy_decompress(legacy.legacy_compress(tiny, plain))).where("x <> y").count() == 0


def test_block_settings(spark):
    text = "[GlobalSettings]\nCmprAlgo = ALGO_INTERP\nErrorBoundMode = REL\nRelErrorBound = 1e-3\ntuningTarget = TUNING_TARGET_CR\n[AlgoSettings]\nInterpolationAlgo = INTERP_ALGO_LINEAR\nalpha = 1.5\nbeta = 3\nautoTuningRate = 0.5\nwavelet = 1\n"
    found = config.load_block_settings(text=text)
    assert found == config.BlockSettings("ALGO_INTERP", "REL", 1e-3, 1e-3, 0.0, 0.0, "TUNING_TARGET_CR", "INTERP_ALGO_LINEAR", 1.5, 3.0, 0.5, ("AlgoSettings.wavelet",))
    f = field_of(spark, np.random.default_rng(2).normal(size=9000).cumsum())
    for name in config.ALGORITHM_NAMES:
        chunks = legacy.block_compress(f, config.BlockSettings(name, "REL", rel_bound=1e-3, sample_rate=0.5))
        assert stats.zipped(f.cells, selection.decompress(chunks)).selectExpr("max(abs(x - y))").first()[0] <= 1e-3 * f.range
    best = [selection.tune_levels(f, 1e-2, t, 1).first() for t in selection.TUNING_TARGETS]
    tried = selection.tune_levels(f, 1e-2, "TUNING_TARGET_CR", 1).collect()
    assert len(tried) == len(selection.LEVELS) and best[1]["bits"] == min(r["bits"] for r in tried) and best[2]["ssim"] == max(r["ssim"] for r in tried)


def test_levels_are_tried_once_for_all_targets(spark):
    assert catalog.QUERIES["tuned_levels"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    f = field_of(spark, np.random.default_rng(9).normal(size=3000).cumsum())
    got = {r["target"]: tuple(r)[1:] for r in selection.best_levels(f, 1e-2, every=2, cells=500).collect()}
    assert got == {t: tuple(selection.tune_levels(f, 1e-2, t, 2, 500).first())[:3] for t in selection.TUNING_TARGETS}
    for shape in ((500,), (9, 31), (5, 6, 7), (1,)):
        a = np.random.default_rng(10).normal(size=shape).astype("f4") * 1e3
        for levels in selection.LEVELS:
            data, back = multilevel.encode_and_decode(a, 1e-3, *levels)
            assert np.array_equal(multilevel.decode(data), back)


def test_command_line(spark, tmp_path, capsys):
    from fieldloom.__main__ import main

    values = np.random.default_rng(6).normal(size=(40, 50)).cumsum(axis=1).astype("<f4")
    (tmp_path / "a.f32").write_bytes(values.tobytes())
    source, shape = str(tmp_path / "a.f32"), ["--dims", "40x50"]
    assert main(["words", "--mode", "REL", "--bound", "1e-4"]) == 0
    assert capsys.readouterr().out.strip() == "1,0,0,1058682594,3944497965,0,0,0,0"
    assert main(["estimate", source, *shape, "--codec", "szp", "--eb", "0.01"], spark) == 0
    assert json.loads(capsys.readouterr().out)["value"] > 1
    assert main(["choose", source, *shape, "--goal", "cr_eb", "--target", "3", "--codecs", "szp,szx", "--prefer", "large", "--bracket", "-5", "1", "0.05"], spark) == 0
    assert 1e-5 < json.loads(capsys.readouterr().out)["eb"] < 10
    for n, how in enumerate((["--goal", "eb_cr", "--target", "0.01", "--codecs", "szp,szx"], ["--codec", "INTERP", "--eb", "0.01"])):
        assert main(["compress", source, str(tmp_path / f"out{n}"), *shape, *how], spark) == 0
        assert main(["decompress", str(tmp_path / f"out{n}"), str(tmp_path / f"back{n}")], spark) == 0
        assert np.abs(np.fromfile(tmp_path / f"back{n}", "<f4").astype(float) - values.ravel()).max() <= 0.01
    assert main(["compress", source, str(tmp_path / "none"), *shape], spark) == 2


def test_stream_of_chunks(spark, tmp_path):
    from fieldloom.streaming import chunks

    values = np.sin(np.arange(400) / 9).astype("f4")
    pieces = spark.createDataFrame([("s", i, i * 100, [100], values[i * 100 : i * 100 + 100].tolist()) for i in range(4)], chunks.ARRIVING)
    pieces.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.ARRIVING).parquet(str(tmp_path / "in"))
    chunks.start(stream, "sz3", 1e-3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = selection.decompress(spark.read.parquet(str(tmp_path / "out"))).orderBy("idx").collect()
    assert len(got) == 400 and max(abs(r["v"] - float(v)) for r, v in zip(got, values, strict=True)) <= 1e-3


@pytest.mark.parametrize(("dims", "ratio"), [((8003, 13), 0.2), ((4001, 40), 0.97), ((600, 6), 1.0), ((3, 50), 0.2), ((41, 30, 22), 0.4)])
def test_zfp_sample_is_arithmetic(spark, dims, ratio):
    starts = []
    for size in dims:
        blocks = size // 4
        k = max(1, int(ratio ** (1 / len(dims)) * blocks))
        starts.append([math.floor(i / (k - 1) * (blocks - 1) + 0.5) * 4 if k > 1 else 0 for i in range(k)])
    axes = [[s + j for s in own for j in range(4)] for own in starts]
    source = np.indices([len(a) for a in axes]).reshape(len(dims), -1)
    source = [np.array(a)[i] for a, i in zip(axes, source, strict=True)]
    inside = np.all([x < d for x, d in zip(source, dims, strict=True)], axis=0)
    want = dict(zip(np.flatnonzero(inside).tolist(), np.ravel_multi_index([x[inside] for x in source], dims).tolist(), strict=True))
    f = field_of(spark, np.zeros(dims))
    sample, out = sampling.sample_zfp(f.with_coords(), f.dims, ratio)
    assert out == tuple(map(len, axes)) and {r["idx"]: r["source_idx"] for r in sample.collect()} == want
    size = len(sampling.sample_zfp(f.with_coords(), dims, ratio)[0]._jdf.queryExecution().analyzed().toJSON())
    assert size < 60_000  # a plan with a list of starts grows with the field


def test_decompress_holds_one_chunk_at_a_time(spark):
    values = np.random.default_rng(8).normal(size=4000).cumsum()
    chunks = selection.compress(field_of(spark, values), ["trunc", "sz3"], [0.0, 0.5], cells=300).coalesce(1)
    back = selection.decompress(chunks, with_codec=True)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # there a batch of rows would hold many chunks
    rows = back.collect()
    assert sorted((r["idx"], r["codec"]) for r in rows) == sorted((i, c) for i in range(4000) for c in ("trunc", "sz3") for _ in range(2))
    assert max(abs(r["v"] - values[r["idx"]]) for r in rows) <= 0.5 + 1e-4


def test_chunk_volume_covers():
    for dims, chunk in (((25, 20, 20), (8, 8, 6)), ((5,), (9,)), ((64, 64), (64, 10))):
        tiles = sampling.chunk_volume(dims, chunk)
        seen = np.zeros(dims, int)
        for t in tiles:
            seen[tuple(slice(t[2 * i], t[2 * i] + t[2 * i + 1]) for i in range(len(dims)))] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("name", ["legacy_mode_words", "szx_components", "value_range", "ssim_3d", "rle_runs", "best_codec_cr", "sample_zfp_2d", "lorenzo1_3d", "entropy_bits"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "orders", "part", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, want[key].values.tolist()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
