"""Command line: run a query, decode files, search or carve an image, find file systems in it, list what there is."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrybed")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the queries")
    sub.add_parser("decoders", help="names of the decoders")
    run = sub.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("query")
    run.add_argument("case", help="folder of the case's tables")
    run.add_argument("out")
    dec = sub.add_parser("decode", help="decode files of a folder, write Parquet")
    dec.add_argument("decoder")
    dec.add_argument("path")
    dec.add_argument("out")
    raw = sub.add_parser("search-raw", help="find text or hex:… in an image, write Parquet")
    raw.add_argument("image")
    raw.add_argument("needle")
    raw.add_argument("out")
    for name, does in (("carve", "find files by signature in an image, write Parquet"), ("gaps", "find where file systems begin in an image, write Parquet")):
        c = sub.add_parser(name, help=does)
        c.add_argument("image")
        c.add_argument("out")
    a = p.parse_args(args)

    from quarrybed.sources import eventlogs, extfs, hives  # noqa: F401  (they register their decoders)
    from quarrybed.sources.decoders import DECODERS, decode

    if a.command == "decoders":
        print("\n".join(sorted(DECODERS)))
        return 0
    from quarrybed.plans import catalogue, problems

    known = {**problems.queries(), **catalogue.queries()}
    if a.command == "queries":
        print("\n".join(sorted(known)))
        return 0
    from pyspark.sql import functions as F

    from quarrybed.functions.text import overlap_bytes
    from quarrybed.operators import carving
    from quarrybed.operators.search import raw_search
    from quarrybed.session import session
    from quarrybed.sources.images import read_image

    if a.command == "run" and a.query not in known or a.command == "decode" and a.decoder not in DECODERS:
        print("unknown name", file=sys.stderr)
        return 2
    spark = session("quarrybed", a.master)
    if a.command == "run":
        df = known[a.query](spark, a.case)
    elif a.command == "decode":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.path)
        files = files.select("path", F.xxhash64("path").alias("id"), "content")
        df = decode(files, a.decoder, "id", "content").join(files.select(F.col("path").alias("source_path"), F.col("id").alias("source_id")), "source_id")
    elif a.command == "carve":
        df = carving.carve_chunks(read_image(spark, a.image, overlap=carving.REACH))
    elif a.command == "gaps":
        df = carving.lost_in_chunks(read_image(spark, a.image, overlap=carving.FS_REACH))
    else:
        df = raw_search(read_image(spark, a.image, overlap=overlap_bytes(a.needle)), a.needle)
    df.write.mode("errorifexists").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
