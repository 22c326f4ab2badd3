"""``python -m quillspark parse PATH [--output FILE] [--format markdown|text|json]``
and ``python -m quillspark serve STORE [--port N]``."""
from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import build
from .server import make_server
from .sources.readers import read_documents


def configure_logging(level: str = "INFO", path: str | None = None) -> None:
    """Log lines of this package to stderr, or to a file."""
    out = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    out.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log = logging.getLogger("quillspark")
    log.handlers[:] = [out]
    log.setLevel(level.upper())
    log.propagate = False


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="parse documents below a path")
    parse.add_argument("path")
    parse.add_argument("--output")
    parse.add_argument("--format", choices=("markdown", "text", "json"), default="markdown")
    parse.add_argument("--metadata", nargs="*", default=[])
    browse = commands.add_parser("serve", help="answer questions about a store over HTTP")
    browse.add_argument("root")
    browse.add_argument("--port", type=int, default=8000)
    parser.add_argument("--log-level", default="INFO")
    parser.add_argument("--log-file")
    args = parser.parse_args(argv)
    configure_logging(args.log_level, args.log_file)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "serve":
        make_server(spark, args.root, args.port).serve_forever()
    pages = read_documents(spark, args.path).withColumn("document_id", F.col("file_name"))
    documents = pages.select("document_id").distinct().withColumn("tags", F.array(*map(F.lit, args.metadata)).cast("array<string>"))
    out = {"markdown": build.format_markdown, "text": build.format_text, "json": build.format_json}[args.format](documents, pages)
    if args.output:
        out.select("text").write.mode("overwrite").text(args.output)
    else:
        for row in out.orderBy("document_id").toLocalIterator():
            sys.stdout.write(row["text"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
