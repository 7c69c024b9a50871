"""python -m rasterloom.cli [options] INPUT OUTPUT: encodes a PNG file anew. Exit code 1 if that fails."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .functions.spec import EncodeOptions, Filter, Level, Strategy
from .plans.encode import EncodeSession
from .sources.png import decode


def options_of(args: argparse.Namespace) -> EncodeOptions:
    pick = lambda kind, name: None if name == "adaptive" else kind[name.upper()]
    level = {"default": Level.DEFAULT, "1": Level.FAST, "6": Level.DEFAULT, "9": Level.HIGH}[args.level]
    return EncodeOptions(args.chunk_size, level, pick(Strategy, args.strategy), pick(Filter, args.filter), args.streaming == "yes")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    p.add_argument("--chunk-size", type=int, default=EncodeOptions().chunk_size)
    p.add_argument("--filter", choices=["adaptive", *(f.name.lower() for f in Filter)], default="adaptive")
    p.add_argument("--level", choices=["default", "1", "6", "9"], default="default")
    p.add_argument("--strategy", choices=["adaptive", *(s.name.lower() for s in Strategy)], default="adaptive")
    p.add_argument("--streaming", choices=["yes", "no"], default="no")
    p.add_argument("--threads", default="*", help="task slots where no Spark session is running")
    p.add_argument("--repeat", type=int, default=1)
    p.add_argument("input")
    p.add_argument("output")
    args = p.parse_args(argv)
    try:
        spec, palette, transparency, rows = decode(open(args.input, "rb").read())
        spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.threads}]").config("spark.ui.enabled", "false").getOrCreate()
        for _ in range(max(1, args.repeat)):
            began = time.perf_counter()
            session = EncodeSession(spark, options_of(args))
            session.write_header(spec)
            if palette:
                session.write_palette(palette)
            if transparency:
                session.write_transparency(transparency)
            session.write_image_rows(rows.tobytes())
            frames = session.finish().orderBy("ordinal")
            with open(args.output, "wb") as f:
                for r in frames.toLocalIterator():
                    f.write(bytes(r["frame"]))
            print(f"Done in {1000 * (time.perf_counter() - began):.0f} ms")
    except (OSError, ValueError, RuntimeError) as problem:
        print(f"rasterloom: {problem}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
