"""Command lines: an interactive search console, resharding, and dataset ingest."""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from termloom.functions.display import result_table, stats_table
from termloom.functions.encoders import Encoder, LexicalEncoder
from termloom.operators.search import SparseRetriever
from termloom.sources.ingest import DatasetIngest
from termloom.sources.store import SparseIndex, open_manifest

HELP = """:help          this text
:stats         statistics of the index
:topk N        results per query (1 or more)
:mode MODE     disk or memory; opens the index again
:quit          leave (also :exit, :q)"""


def parse_command(line: str) -> tuple[str | None, list[str]]:
    """(command in lower case, arguments) of a line that starts with ``:``; (None, []) otherwise."""
    parts = line[1:].split() if line.startswith(":") else []
    return (parts[0].lower(), parts[1:]) if parts else (None, [])


def embedding_cosines(query: str, texts: list[str], embed: Callable[[list[str]], list] | None) -> list[float] | None:
    """A second score for display, from full embeddings; the order of results stays."""
    if embed is None or not texts:
        return None
    vectors = [[float(x) for x in v] for v in embed([query, *texts])]
    own = vectors[0]
    size = math.sqrt(sum(x * x for x in own))
    out = []
    for v in vectors[1:]:
        product = size * math.sqrt(sum(x * x for x in v))
        out.append(sum(a * b for a, b in zip(own, v, strict=True)) / product if product else 0.0)
    return out


class Console:
    def __init__(self, spark: SparkSession, path: str, model: Encoder | None = None, mode: str = "disk", top_k: int = 5, embed=None, write: Callable[[str], None] = print) -> None:
        self.spark, self.path, self.mode, self.top_k, self.embed, self.write = spark, path, mode, max(1, top_k), embed, write
        self.model = model or LexicalEncoder()
        self.reader = SparseRetriever(spark, path, mode)

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            line = line.strip()
            if line and not self.handle(line):
                break

    def handle(self, line: str) -> bool:
        """Answer one line; False to leave."""
        command, args = parse_command(line)
        if command is None:
            if not line.startswith(":"):
                found = self.reader.search_text(line, self.model, self.top_k, return_text=True)
                self.write(result_table(found, embedding_cosines(line, [r.text or "" for r in found], self.embed)))
        elif command in ("quit", "exit", "q"):
            return False
        elif command == "help":
            self.write(HELP)
        elif command == "stats":
            self.write(stats_table(self.reader.snapshot.stats()))
        elif command == "topk":
            if len(args) == 1 and args[0].isdigit() and int(args[0]) >= 1:
                self.top_k = int(args[0])
                self.write(f"top_k = {self.top_k}")
            else:
                self.write("usage: :topk N, N at least 1")
        elif command == "mode":
            if args in (["disk"], ["memory"]):
                self.reader.close()
                self.mode = args[0]
                self.reader = SparseRetriever(self.spark, self.path, self.mode)
                self.write(f"mode = {self.mode}")
            else:
                self.write("usage: :mode disk or :mode memory")
        else:
            self.write(f"unknown command :{command}; :help lists all")
        return True


def _session() -> SparkSession:
    return SparkSession.builder.appName("termloom").getOrCreate()


def search_main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom search", description="Search an index.")
    parser.add_argument("index_dir")
    parser.add_argument("--mode", choices=("disk", "memory"), default="disk")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--num-workers", type=int, default=4, help="accepted; Spark decides")
    args = parser.parse_args(argv)
    spark = spark or _session()
    try:
        open_manifest(spark, args.index_dir)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    Console(spark, args.index_dir, mode=args.mode, top_k=args.top_k).run(sys.stdin)
    return 0


def reshard_main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom reshard", description="Rewrite an index into segments of another size.")
    parser.add_argument("index_dir")
    parser.add_argument("--shard-size", type=float, default=32, help="in MB")
    parser.add_argument("--keep-originals", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or _session()
    try:
        open_manifest(spark, args.index_dir)
        print(stats_table(SparseIndex(spark, args.index_dir).reshard(args.shard_size, args.keep_originals)))
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def ingest_main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom ingest-dataset", description="Add a dataset to an index.")
    parser.add_argument("config")
    parser.add_argument("--batch-size", type=int, default=100)
    parser.add_argument("--max-docs", type=int)
    parser.add_argument("--resume", action="store_true")
    args = parser.parse_args(argv)
    print(stats_table(DatasetIngest(spark or _session(), args.config).ingest(args.batch_size, args.max_docs, args.resume)))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    commands = {"search": search_main, "reshard": reshard_main, "ingest-dataset": ingest_main}
    if not argv or argv[0] not in commands:
        print(f"usage: termloom {{{','.join(commands)}}} ...", file=sys.stderr)
        return 2
    return commands[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
