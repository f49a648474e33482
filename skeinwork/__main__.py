"""python -m skeinwork FOLDER: packs a folder of documents."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .functions.text import ESTIMATE
from .plans import pack
from .tokens import ENCODINGS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skeinwork", description="Packs a folder of documents as context for agents.")
    p.add_argument("folder")
    p.add_argument("-o", "--output", help="folder of the pack (default: FOLDER-context)")
    p.add_argument("-a", "--agent", action="append", help=f"{', '.join(sorted(pack.AGENTS))}, or all; may be given several times")
    p.add_argument("-m", "--mode", choices=("fast", "scientific"), default="fast", help="PDF engine")
    p.add_argument("--chunk-size", type=int, default=500)
    p.add_argument("--chunk-by", choices=("heading", "tokens"), default="heading")
    p.add_argument("--encoding", default=ESTIMATE, help=f"token counter: {', '.join((ESTIMATE, *ENCODINGS))}, or the path of a vocabulary")
    p.add_argument("--cache", help="folder in which vectors are kept for the next run (default: none are)")
    return p


def main(args: list[str] | None = None) -> int:
    logging.basicConfig(format="%(message)s", level=logging.INFO, stream=sys.stderr)
    o = parser().parse_args(args)
    try:
        pack.resolve_agents(o.agent or ["claude"])
        spark = SparkSession.builder.appName("skeinwork").getOrCreate()
        out = pack.free_folder(spark, o.output or o.folder.rstrip("/") + "-context")
        pack.pack_folder(spark, o.folder, out, o.agent, o.chunk_by, o.chunk_size, o.encoding, o.mode, o.cache)
    except (ImportError, ValueError) as e:
        logging.error("error: %s", e)
        return 1
    logging.info("written to %s", out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
