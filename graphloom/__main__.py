"""python -m graphloom FOLDER index ROOT | search|context|explore|callers|callees|node|file|serve WORDS... | trace FROM TO

FOLDER holds the index (or tables of the same names)."""

from __future__ import annotations

import sys

from graphloom.engine import Engine
from graphloom.index import index_repository
from graphloom.server import MISSING, serve
from graphloom.session import local_session
from graphloom.sources.repository import project_words

COMMANDS = ("index", "search", "context", "explore", "callers", "callees", "trace", "node", "file", "serve")


def _table(rows: list, columns: list[str]) -> str:
    """Rows below their column names, in columns of equal width."""
    cells = [columns, *([str("" if x is None else x) for x in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in cells)


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in COMMANDS or len(args) < 3 and args[1] != "serve":
        print(__doc__)
        return 2
    folder, command, *words = args
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if command == "index":
        index = index_repository(spark, words[0], folder)
        print("\n".join(f"{name}: {index.table(name).count()}" for name in ("files", "nodes", "edges", "unresolved_refs")))
        return 0
    engine = Engine(spark, folder, project_words(words[0]) if command == "serve" and words else frozenset())
    if command == "serve":
        serve(engine)
    elif not engine.ready:
        print(MISSING)
    elif command == "trace":
        print("\n".join(engine.trace(words[0], words[-1])) or "no way between them")
    elif command in ("context", "explore"):
        print(getattr(engine, command)(" ".join(words)))
    elif command == "node":
        print(engine.node(words[0], words[1] if len(words) > 1 else None, code=True))
    elif command == "file":
        print(engine.node(file=words[0]))
    else:
        rows = engine.search(" ".join(words)) if command == "search" else getattr(engine, command)(words[0])
        got = rows.collect()
        print(_table(got, rows.columns) if got else "nothing found")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
