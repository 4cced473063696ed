"""python -m plumbline COMMAND HOME ...: the stored project below the folder HOME, or the registered queries.

  ingest HOME ROOT VERSION [REPO]     documents of a local tree        search HOME QUESTION [MODE] [STRATEGY]   hits
  chunk HOME                          chunks by both strategies         ask HOME QUESTION [STRATEGY]              a grounded answer
  embed HOME                          vectors that are missing          symbols HOME ROOT VERSION                 symbol table of a source tree
  index HOME                          lexical and dense index           verify HOME TEXT                          flags against the symbol table
  check HOME                          counts                            golden HOME FILE                          problems of golden questions
  list                                the registered queries            run NAME FOLDER [OUT]                     one of them over a folder's tables
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.commands import Project
from plumbline.plans import catalog

#: Least and most arguments after HOME, and what they do.
COMMANDS: dict[str, tuple[int, int, Callable[..., DataFrame]]] = {
    "ingest": (2, 3, Project.ingest),
    "chunk": (0, 0, Project.chunk),
    "embed": (0, 0, Project.embed),
    "index": (0, 0, Project.index),
    "check": (0, 0, Project.check),
    "search": (1, 3, lambda p, question, *rest: p.search([question], *rest)),
    "ask": (1, 2, lambda p, question, *rest: p.ask([question], None, *rest)),
    "symbols": (2, 2, Project.extract_symbols),
    "verify": (1, 1, lambda p, text: p.verify([text])),
    "golden": (1, 1, Project.golden),
}


def main(args: list[str]) -> int:
    if args[:1] == ["list"] and len(args) == 1:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    command = COMMANDS.get(args[0]) if args else None
    if command and command[0] <= len(args) - 2 <= command[1]:
        spark = SparkSession.builder.appName(f"plumbline {args[0]}").getOrCreate()
        command[2](Project(spark, args[1]), *args[2:]).show(50, truncate=100)
        return 0
    if args[:1] != ["run"] or len(args) not in (3, 4) or args[1] not in catalog.QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    found = catalog.QUERIES[args[1]](SparkSession.builder.appName(f"plumbline {args[1]}").getOrCreate(), args[2])
    if len(args) == 4:
        found.write.mode("overwrite").parquet(args[3])
    else:
        found.show(20, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
