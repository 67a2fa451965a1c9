"""Command line over raw files: estimate, choose, compress, decompress, words.

    python -m fieldloom choose data.f32 --dims 500x500x100 --goal cr_eb --target 20 --prefer large --bracket -5 1 0.01
    python -m fieldloom compress data.f32 out --dims 500x500x100 --goal eb_cr --target 1e-3
    python -m fieldloom compress data.f32 out --settings codec.config
    python -m fieldloom decompress out data.back
"""

from __future__ import annotations

import argparse
import json
import sys

from fieldloom.functions import metadata


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m fieldloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = out.add_subparsers(dest="what", required=True)

    def command(name: str, *files: str) -> argparse.ArgumentParser:
        own = what.add_parser(name)
        for file in files:
            own.add_argument(file)
        return own

    def field(own: argparse.ArgumentParser) -> None:
        own.add_argument("--dtype", default="float", choices=metadata.DTYPES)
        own.add_argument("--dims", help="extents, slowest first, as 500x500x100")
        own.add_argument("--big-endian", action="store_true")

    def goal(own: argparse.ArgumentParser, required: bool) -> None:
        own.add_argument("--goal", required=required, help="what is fixed and what is improved, as cr_eb")
        own.add_argument("--target", type=float, required=required)
        own.add_argument("--codecs", default="sz3,zfp,szx,sperr")
        own.add_argument("--prefer", default="small", choices=("small", "large"))
        own.add_argument("--bracket", type=float, nargs=3, metavar=("LOW", "HIGH", "TOLERANCE"), help="of log10 of the bound")

    own = command("estimate", "source")
    field(own)
    own.add_argument("--codec", required=True)
    own.add_argument("--eb", type=float, required=True)
    own.add_argument("--metric", default="cr", choices=("cr", "psnr", "ssim"))
    own = command("choose", "source")
    field(own)
    goal(own, True)
    own = command("compress", "source", "out")
    field(own)
    goal(own, False)
    own.add_argument("--codec")
    own.add_argument("--eb", type=float)
    own.add_argument("--settings", help="a setting file")
    own.add_argument("--block-settings", help="a setting file of the block codecs")
    command("decompress", "source", "out")
    own = command("words")
    own.add_argument("--mode", required=True, choices=("ABS", "REL", "PW_REL", "PSNR"))
    own.add_argument("--bound", type=float, required=True)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.what == "words":
        print(",".join(map(str, metadata.h5repack_words(args.mode, args.bound))))
        return 0
    from pyspark.sql import SparkSession

    from fieldloom.operators import legacy, selection
    from fieldloom.sources import config, raw
    from fieldloom.sources.fixtures import Field

    spark = spark or SparkSession.builder.appName("fieldloom").getOrCreate()
    if args.what == "decompress":
        chunks = raw.read_chunks(spark, args.source)
        raw.write_raw(Field("back", selection.decompress(chunks), (0,)), args.out)
        return 0
    dims = tuple(map(int, args.dims.split("x"))) if args.dims else None
    field = raw.read_raw(spark, args.source, args.dtype, dims, args.big_endian).keep()
    if args.what == "estimate":
        row = selection.estimate(field, args.codec, args.eb, args.metric).first()
        print(json.dumps(row.asDict()))
        return 0
    bracket = dict(zip(("low", "largest", "tolerance"), (args.bracket[0], 10 ** args.bracket[1], args.bracket[2]), strict=True)) if args.bracket else None
    if args.what == "choose" or args.goal:
        row = selection.choose(field, args.goal, args.target, args.codecs.split(","), prefer=args.prefer, bracket=bracket).first()
        print(json.dumps(row.asDict()))
        if args.what == "choose":
            return 0
        method = {v: k for k, v in metadata.GOALS.items()}[args.goal]
        raw.write_chunks(selection.compress(field, row["codec"], row["eb"], method), args.out)
    elif args.settings:
        raw.write_chunks(legacy.legacy_compress(field, config.load_config(args.settings)), args.out)
    elif args.block_settings:
        raw.write_chunks(legacy.block_compress(field, config.load_block_settings(args.block_settings)), args.out)
    elif args.codec and args.eb is not None:
        raw.write_chunks(selection.compress(field, args.codec, args.eb), args.out)
    else:
        print("compress needs a goal with a target, a codec with a bound, or settings", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
