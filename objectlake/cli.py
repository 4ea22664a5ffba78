"""The command line: python -m objectlake.cli STORE COMMAND ...

    mkfs | info | df | search KIND TEXT [NAME] | find TEXT | similar ID | enrich | bonds ID | sync | fsck | ls [PATH] | cat PATH | mkdir PATH |
    write PATH [TEXT] | rm PATH | mv PATH TO | snapshot [LABEL] | restore N | snapshots | compact |
    object add NAME KEY=VALUE ... | object get ID | object list | serve [PORT]
"""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.store import Store


def _plain(x: Any) -> Any:
    if isinstance(x, bytes | bytearray):
        return bytes(x).decode("utf-8", "backslashreplace")
    return x


def _typed(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def run(store: Store, args: list[str], out: TextIO = sys.stdout, source: TextIO = sys.stdin) -> int:
    """One command; 0, or 1 with a message for what isn't there or can't be done, or 2 for an unknown command."""

    def show(x: Any) -> None:
        for row in x.toLocalIterator() if isinstance(x, DataFrame) else [x]:
            print(json.dumps({k: _plain(v) for k, v in (row.asDict() if hasattr(row, "asDict") else row).items()}, default=str), file=out)

    def bonds(object_id: str) -> DataFrame:
        return store.edges().where((F.col("src") == object_id) | (F.col("dst") == object_id)).orderBy("src", "pos")

    def objects(what: str, *rest: str) -> None:
        if what == "add":
            show({"object_id": store.make(rest[0], {k: _typed(v) for k, v in (r.split("=", 1) for r in rest[1:])})})
        elif what == "get":
            show(store.get(rest[0]))
        else:
            show(store.summaries())

    def serve(port: str = "8080") -> None:
        from objectlake.api import serve

        serve(store, int(port))

    commands = {
        "mkfs": store.create,
        "info": lambda: show({"path": store.data.path, "version": store.data.manifest()["version"]} | store.totals()),
        "df": lambda: show({k: v for k, v in store.totals().items() if k in ("objects", "bytes")}),
        "search": lambda kind, q, name="name": show(store.search(kind, q, name)),
        "find": lambda text: show(store.find(text)),
        "similar": lambda object_id: show(store.similar(object_id)),
        "enrich": lambda: show({"written": store.enrich()}),
        "bonds": lambda object_id: show(bonds(object_id)),
        "sync": lambda: show({"version": store.data.checkpoint("attributes")}),
        "fsck": lambda: show(store.check()),
        "ls": lambda path="/": show(store.listing(path)),
        "cat": lambda path: print(_plain(store.get(store.resolve(path)).get("content", b"")), end="", file=out),
        "mkdir": lambda path: show({"object_id": store.make(path, {}, "dir")}),
        "write": lambda path, text=None: show({"object_id": store.write(path, (source.read() if text is None else text).encode())}),
        "rm": store.remove,
        "mv": store.move,
        "snapshot": lambda label="": show({"snapshot_id": store.data.snapshot(label)}),
        "restore": lambda n: show({"version": store.data.restore(int(n))}),
        "snapshots": lambda: show(store.data.snapshots()),
        "compact": lambda: show(dict(zip(("tables", "bytes_freed"), store.data.compact()))),
        "object": objects,
        "serve": serve,
    }
    if not args or args[0] not in commands:
        print(__doc__, file=out)
        return 2
    try:
        commands[args[0]](*args[1:])
    except (KeyError, OSError, ValueError, TypeError) as e:
        print(f"{type(e).__name__}: {e}", file=out)
        return 1
    return 0


def main() -> None:
    from objectlake.session import session

    if len(sys.argv) < 3:
        print(__doc__)
        sys.exit(2)
    spark = session(**{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(Store(spark, sys.argv[1]), sys.argv[2:]))


if __name__ == "__main__":
    main()
