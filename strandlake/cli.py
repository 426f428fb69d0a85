"""build, encode and decode from a command line; run it by spark-submit or python -m strandlake.cli."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

log = logging.getLogger("strandlake")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    verbs = top.add_subparsers(dest="verb", required=True)
    build = verbs.add_parser("build", help="index reference files")
    build.add_argument("files", nargs="*")
    build.add_argument("-l", "--list", dest="listed")
    build.add_argument("-o", "--output-prefix", required=True)
    build.add_argument("-k", type=int, default=31)
    for name, default in (("prefix-precalc", 8), ("threads", 1), ("mem-gb", 4)):
        build.add_argument(f"--{name}", type=int, default=default, help="taken for compatibility; Spark's settings decide")
    build.add_argument("--temp-dir", help="taken for compatibility; Spark's settings decide")
    build.add_argument("-d", "--dedup-batches", action="store_true", help="taken for compatibility; k-mers are always distinct")
    build.add_argument("--verbose", action="store_true")
    encode = verbs.add_parser("encode", help="reads to an encoded file")
    encode.add_argument("query")
    encode.add_argument("-i", "--index", required=True)
    encode.add_argument("-o", "--output", required=True)
    encode.add_argument("--blocks", action="store_true", help="a folder of blocks as Parquet, written by the tasks, in place of one file")
    decode = verbs.add_parser("decode", help="an encoded file to FASTA")
    decode.add_argument("input")
    decode.add_argument("-i", "--index", required=True)
    decode.add_argument("-o", "--output", required=True)
    decode.add_argument("--blocks", action="store_true", help="the input is a folder of blocks")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from strandlake.operators import blocks, decode, index, tokens
    from strandlake.sources import fastx, sinks

    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verb != "build" or args.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    if args.verb == "build":
        if bool(args.files) == bool(args.listed):
            raise SystemExit("build takes either files or a list")
        refs = fastx.read_all(spark, args.files, args.listed)
        sinks.save_index(index.with_lcs(index.build(refs, args.k), args.k), args.output_prefix, args.k)
    elif args.verb == "encode":
        nodes, k = fastx.load_index(spark, args.index)
        reads = fastx.read_sequences(spark, [args.query])
        save = sinks.save_blocks if args.blocks else sinks.save_encoded
        save(blocks.write_blocks(tokens.pack(tokens.tokenize(nodes, reads, k))), args.output, fastx.stored_fingerprint(spark, args.index))
    else:
        nodes, k = fastx.load_index(spark, args.index)
        fingerprint = fastx.stored_fingerprint(spark, args.index)
        if args.blocks:
            packed = fastx.load_blocks(spark, args.input, blocks.RECORDS, fingerprint)
        else:
            fastx.check_fingerprint(args.input, fingerprint)
            packed = fastx.read_encoded(spark, args.input, blocks.RECORDS)
        sinks.save_fasta(decode.decode(blocks.as_tokens(packed), nodes, k), args.output)
    log.info("%s done", args.verb)


if __name__ == "__main__":
    main()
