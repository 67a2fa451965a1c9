"""The single-codec surface: settings instead of goals, with optional tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldloom.operators import selection, stats
from fieldloom.operators.codecs import codec
from fieldloom.sources.config import BlockSettings, Setting, Settings, Target
from fieldloom.sources.fixtures import Field

SMALL = 20  # fields with fewer cells are stored as they are


def absolute_bound(setting: Setting, field: Field) -> float:
    """The absolute bound of a mode; FIX_RATE has the bound at which the estimated compression ratio is the rate."""
    modes = {"ABS": "abs", "REL": "rel", "VR_REL": "rel", "PSNR": "psnr", "NORM": "norm", "ABS_AND_REL": "abs_and_rel", "ABS_OR_REL": "abs_or_rel"}
    if setting.mode == "FIX_RATE":
        name = setting.codec.lower()
        if name not in selection.SURROGATES:
            raise ValueError(f"no estimate of the ratio of {setting.codec}, which FIX_RATE needs")
        if setting.rate <= 0:
            raise ValueError("FIX_RATE needs a rate above 0")
        probes = selection.find_bound(field.keep(), name, "cr", setting.rate)
        return probes[-1][0] if probes else 0.0
    if setting.mode not in modes:
        raise ValueError(f"mode {setting.mode} has no absolute bound")
    return stats.error_bound(modes[setting.mode], field.range, field.n, abs_=setting.abs_bound, rel=setting.rel_bound, psnr_=setting.precision, norm=setting.abs_bound)


def legacy_compress(field: Field, settings: Settings, override: Setting | None = None) -> DataFrame:
    """Chunks by the settings' codec; a tuned bound belongs to this field only.  Errors given with the call go before the file's.

    A codec that this engine doesn't have is an error, never replaced by another one.
    """
    setting, target = override or settings.setting, settings.target
    name = setting.codec.lower()
    codec(name)
    if field.n < SMALL:
        return selection.compress(field, "trunc", 0.0)
    eb = tuned(field, name, target) if target.tune and name in selection.SURROGATES else absolute_bound(setting, field)
    return selection.compress(field, name, eb)


def block_compress(field: Field, settings: BlockSettings) -> DataFrame:
    """Chunks by the algorithm of block settings.

    With a sample rate the levels of interpolation are tuned on that share of the chunks for the tuning target; they
    concern the algorithm of interpolation alone.
    """
    mode = {"ABS": "abs", "REL": "rel", "PSNR": "psnr", "NORM": "norm", "ABS_AND_REL": "abs_and_rel", "ABS_OR_REL": "abs_or_rel"}[settings.mode]
    eb = stats.error_bound(mode, field.range, field.n, abs_=settings.abs_bound, rel=settings.rel_bound, psnr_=settings.psnr_bound, norm=settings.norm_bound)
    if settings.algorithm != "ALGO_INTERP":
        return selection.compress(field, settings.algorithm.removeprefix("ALGO_"), eb)
    level = (settings.alpha, settings.beta, settings.interpolation == "INTERP_ALGO_LINEAR")
    if settings.sample_rate > 0:
        best = selection.tune_levels(field, eb, settings.tuning, max(1, round(1 / settings.sample_rate))).first()
        level = (best["alpha"], best["beta"], best["linear"])
    return selection.compress(field, "INTERP", eb, options={"alpha": level[0], "beta": level[1], "linear": level[2]})


def tuned(field: Field, name: str, target: Target) -> float:
    share = target.tolerance / 100 if target.tolerance > 1 else target.tolerance
    return selection.autotune(field.keep(), name, target.metric, target.value, share)[0]


def legacy_decompress(chunks: DataFrame) -> DataFrame:
    return selection.decompress(chunks)
