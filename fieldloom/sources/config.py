"""Settings from INI files, with defaults."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, replace

#: The codec, mode and metric names that setting files may hold.
CODEC_NAMES = ("SZ2", "SZ3", "QOZ", "ZFP", "DR", "BG", "SZX")
MODE_NAMES = ("ABS", "REL", "VR_REL", "ABS_AND_REL", "ABS_OR_REL", "PSNR", "NORM", "FIX_RATE")
METRIC_NAMES = ("CR", "PSNR", "SSIM")
#: Codecs of this engine that setting files may name besides.
OWN_CODECS = ("SZP", "SPERR", "CUSZP")


@dataclass(frozen=True)
class Setting:
    codec: str = "SZ3"
    mode: str = "ABS"
    abs_bound: float = 0.01
    rel_bound: float = 0.0
    precision: int = 0
    rate: float = 0.0


@dataclass(frozen=True)
class Target:
    metric: str = "cr"
    tune: bool = False
    value: float = 60.0
    tolerance: float = 10.0


@dataclass(frozen=True)
class Settings:
    setting: Setting = field(default_factory=Setting)
    target: Target = field(default_factory=Target)
    unknown: tuple[str, ...] = ()


def one_of(*names: str):
    def parse(value: str) -> str:
        if value not in names:
            raise ValueError(f"{value} is none of {', '.join(names)}")
        return value

    return parse


#: Sections and keys of setting files.
KEYS = {
    ("GlobalSettings", "CompressorID"): ("setting", "codec", one_of(*CODEC_NAMES, *OWN_CODECS)),
    ("GlobalSettings", "CompressionMode"): ("setting", "mode", one_of(*MODE_NAMES)),
    ("GlobalSettings", "AbsErrorBound"): ("setting", "abs_bound", float),
    ("GlobalSettings", "RelErrorBound"): ("setting", "rel_bound", float),
    ("GlobalSettings", "Precision"): ("setting", "precision", int),
    ("GlobalSettings", "FixedCompressionRate"): ("setting", "rate", float),
    ("SECRESettings", "UseSECRE"): ("target", "tune", lambda x: int(x) != 0),
    ("SECRESettings", "SECREMetric"): ("target", "metric", lambda x: one_of(*METRIC_NAMES)(x).lower()),
    ("SECRESettings", "SECRETarget"): ("target", "value", float),
    ("SECRESettings", "SECRETolerance"): ("target", "tolerance", float),
}


def load_config(path: str | None = None, text: str | None = None) -> Settings:
    """Settings from a file or text; without either the defaults.

    Keys that aren't known are listed in unknown, not fatal; a known key with a value that it can't have is an error.
    """
    out, unknown = Settings(), []
    if path is None and text is None:
        return out
    parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), strict=False)
    parser.optionxform = str  # keys keep their letter case
    if text is not None:
        parser.read_string(text)
    elif not parser.read(path):
        raise FileNotFoundError(path)
    for section in parser.sections():
        for key, value in parser.items(section):
            if (section, key) not in KEYS:
                unknown.append(f"{section}.{key}")
                continue
            part, name, parse = KEYS[section, key]
            out = replace(out, **{part: replace(getattr(out, part), **{name: parse(value.strip())})})
    return replace(out, unknown=tuple(unknown))


#: Algorithms, interpolators, bound modes and tuning targets that block settings may name.
ALGORITHM_NAMES = ("ALGO_LORENZO_REG", "ALGO_INTERP_LORENZO", "ALGO_INTERP")
INTERPOLATION_NAMES = ("INTERP_ALGO_LINEAR", "INTERP_ALGO_CUBIC")
BOUND_NAMES = ("ABS", "REL", "PSNR", "NORM", "ABS_AND_REL", "ABS_OR_REL")
TUNING_NAMES = ("TUNING_TARGET_RD", "TUNING_TARGET_CR", "TUNING_TARGET_SSIM", "TUNING_TARGET_AC")


@dataclass(frozen=True)
class BlockSettings:
    """Settings of the block codecs: which algorithm, its bound, and the levels of interpolation."""

    algorithm: str = "ALGO_INTERP_LORENZO"
    mode: str = "ABS"
    abs_bound: float = 1e-3
    rel_bound: float = 0.0
    psnr_bound: float = 0.0
    norm_bound: float = 0.0
    tuning: str = "TUNING_TARGET_RD"
    interpolation: str = "INTERP_ALGO_CUBIC"
    alpha: float = 1.0
    beta: float = 1.0
    sample_rate: float = 0.0
    unknown: tuple[str, ...] = ()


#: Sections and keys of block settings, as far as this engine has what they set.
BLOCK_KEYS = {
    ("GlobalSettings", "CmprAlgo"): ("algorithm", one_of(*ALGORITHM_NAMES)),
    ("GlobalSettings", "ErrorBoundMode"): ("mode", one_of(*BOUND_NAMES)),
    ("GlobalSettings", "AbsErrorBound"): ("abs_bound", float),
    ("GlobalSettings", "RelErrorBound"): ("rel_bound", float),
    ("GlobalSettings", "PSNRErrorBound"): ("psnr_bound", float),
    ("GlobalSettings", "L2NormErrorBound"): ("norm_bound", float),
    ("GlobalSettings", "tuningTarget"): ("tuning", one_of(*TUNING_NAMES)),
    ("AlgoSettings", "InterpolationAlgo"): ("interpolation", one_of(*INTERPOLATION_NAMES)),
    ("AlgoSettings", "alpha"): ("alpha", float),
    ("AlgoSettings", "beta"): ("beta", float),
    ("AlgoSettings", "autoTuningRate"): ("sample_rate", float),
}


def load_block_settings(path: str | None = None, text: str | None = None) -> BlockSettings:
    """Settings of the block codecs; keys that set what this engine doesn't have are listed in unknown."""
    parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), strict=False)
    parser.optionxform = str
    if text is not None:
        parser.read_string(text)
    elif path is not None and not parser.read(path):
        raise FileNotFoundError(path)
    found, unknown = {}, []
    for section in parser.sections():
        for key, value in parser.items(section):
            if (section, key) in BLOCK_KEYS:
                name, parse = BLOCK_KEYS[section, key]
                found[name] = parse(value.strip())
            else:
                unknown.append(f"{section}.{key}")
    return BlockSettings(**found, unknown=tuple(unknown))
