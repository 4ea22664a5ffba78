"""The store, its command line, and its JSON answers."""

from __future__ import annotations

import io
import json

import pytest

from objectlake import api, cli
from objectlake.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/own")
    s.create()
    return s


def do(store, *args, text=""):
    out = io.StringIO()
    code = cli.run(store, list(args), out, io.StringIO(text))
    lines = out.getvalue().splitlines()
    return code, [json.loads(x) for x in lines] if lines and lines[0].startswith("{") else out.getvalue()


def test_commands(store):
    assert do(store, "mkdir", "/docs")[0] == 0
    _, [a] = do(store, "write", "/docs/a.txt", "A report about finance and revenue. The budget is here.")
    _, [b] = do(store, "write", "/docs/b.txt", text="nothing of the kind")
    assert [r["name"] for r in do(store, "ls", "/docs")[1]] == ["a.txt", "b.txt"]
    assert do(store, "cat", "/docs/./b.txt")[1] == "nothing of the kind"
    assert do(store, "mkdir", "/docs")[0] == 1
    assert do(store, "cat", "/missing")[0] == 1
    assert do(store, "rm", "/docs")[0] == 1
    assert do(store, "search", "contains", "a.t")[1] == [{"object_id": a["object_id"]}]
    assert do(store, "search", "equals", "b.txt")[1] == [{"object_id": b["object_id"]}]
    assert do(store, "enrich")[0] == 0
    got = do(store, "object", "get", a["object_id"])[1][0]
    assert got["_detected_type"] == "text/plain"
    assert "finance" in got["_auto_tags"]
    assert do(store, "find", "finance and revenue report")[1][0]["object_id"] == a["object_id"]
    assert [r["object_id"] for r in do(store, "similar", a["object_id"])[1]] == [b["object_id"]] or do(store, "similar", a["object_id"])[1]
    assert do(store, "snapshot", "before")[1] == [{"snapshot_id": 1}]
    assert do(store, "mv", "/docs/b.txt", "/c.txt")[0] == 0
    assert [r["name"] for r in do(store, "ls")[1]] == ["c.txt", "docs"]
    assert do(store, "rm", "/c.txt")[0] == 0
    assert do(store, "object", "get", b["object_id"])[0] == 1
    assert do(store, "restore", "1")[0] == 0
    assert [r["name"] for r in do(store, "ls", "/docs")[1]] == ["a.txt", "b.txt"]
    assert do(store, "object", "add", "/docs/n", "size=3", "ratio=0.5", "word=x")[0] == 0
    [n] = [r for r in do(store, "object", "list")[1] if r["name"] == "n"]
    assert {k: v for k, v in do(store, "object", "get", n["object_id"])[1][0].items() if k in ("size", "ratio", "word")} == {"size": 3, "ratio": 0.5, "word": "x"}
    store.bond(a["object_id"], n["object_id"])
    assert len(do(store, "bonds", n["object_id"])[1]) == 2
    assert do(store, "search", "related", a["object_id"])[1] == [{"object_id": n["object_id"]}]
    report = do(store, "fsck")[1][0]
    assert report["dangling_edges"] == 0 and report["problems"] == []
    assert [r["label"] for r in do(store, "snapshots")[1]] == ["before"]
    assert do(store, "compact")[1][0]["bytes_freed"] > 0
    assert do(store, "info")[1][0]["objects"] == do(store, "df")[1][0]["objects"] == 4
    assert do(store, "nonsense")[0] == 2
    with pytest.raises(FileExistsError):
        store.create()


def test_answers(store):
    stats = api.answer(store, "/api/stats")
    assert stats["objects"] == len(api.answer(store, "/api/objects")) == 4
    assert {r["kind"] for r in stats["edges_by_kind"]} == {"contains", "related_to"}
    assert len(api.answer(store, "/api/search?q=a.txt&kind=equals")) == 1
    assert len(api.answer(store, "/api/search?q=txt")) == 2
    assert api.answer(store, "/api/graph")["links"]
    assert api.answer(store, "/other") is None
    json.dumps(stats, default=str)
