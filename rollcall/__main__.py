"""Commands over tables of words: `python -m rollcall check WORDS`, `python -m rollcall batch WORDS FOLDER`."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import batch
from .sources.tables import WORDS, read


def main(argv: Sequence[str] | None = None) -> int:
    """The exit code: check gives 0 even with issues, batch 2 if a document failed and 1 if there is none."""
    parser = argparse.ArgumentParser(prog="rollcall")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="classes and issues of the documents, nothing is written")
    export = commands.add_parser("batch", help="one CSV a class, and a manifest")
    for p in (check, export):
        p.add_argument("words", help="table of words (Parquet)")
    export.add_argument("folder")
    export.add_argument("--no-nia", dest="nia", action="store_false")
    for flag in ("repetix", "materia", "cased"):
        export.add_argument(f"--{flag}", action="store_true")
    args = parser.parse_args(argv)
    words = read(SparkSession.builder.getOrCreate(), args.words, WORDS)
    if args.command == "check":
        for r in batch.plan(words)[0].orderBy("source", "file_name").toLocalIterator():
            print(r.status, r.source, r.file_name or "", r.n_rows, ",".join(r.issues), sep="\t")
        return 0
    done = batch.export(words, args.folder, args.nia, args.repetix, args.materia, args.cased)
    print(f"documents={done.documents} files={done.files} failures={done.failures}")
    return done.exit_code


if __name__ == "__main__":
    sys.exit(main())
