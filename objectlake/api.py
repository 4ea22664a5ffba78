"""Read-only JSON answers about a store, and a small server for them.

/api/stats, /api/objects, /api/graph, /api/search?q=&kind=&dim=; / is a page that shows the counts.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from objectlake.operators import graph
from objectlake.store import Store

#: Nodes and edges of the graph that are sent, and hits of a search: what one page shows.
SHOWN = 1000
PAGE = "<!doctype html><title>objectlake</title><pre id=o></pre><script>fetch('/api/stats').then(r=>r.json()).then(s=>o.textContent=JSON.stringify(s,null,1))</script>"


def answer(store: Store, target: str) -> Any:
    """What a GET of a path with its query returns; None for paths that aren't there."""
    url = urlsplit(target)
    query = {k: v[0] for k, v in parse_qs(url.query).items()}
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731 - of bounded results only
    if url.path == "/api/stats":
        return store.totals() | {"attributes_by_name": rows(store.attribute_histogram()), "edges_by_kind": rows(store.kind_histogram())}
    if url.path == "/api/objects":
        return rows(store.summaries(100))
    if url.path == "/api/graph":
        nodes = graph.nodes(store.objects(), store.attributes()).orderBy("object_id").limit(SHOWN)
        links = store.edges().select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "strength").orderBy("source", "target").limit(SHOWN)
        return {"nodes": rows(nodes), "links": rows(links)}
    if url.path == "/api/search":
        return rows(store.search(query.get("kind", "contains"), query.get("q", ""), query.get("dim", "name")).orderBy("object_id").limit(SHOWN))
    return None


def serve(store: Store, port: int = 8080, host: str = "127.0.0.1") -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            page = self.path in ("/", "/index.html")
            found = PAGE if page else answer(store, self.path)
            body = (found if page else json.dumps(found, default=str)).encode()
            self.send_response(404 if found is None else 200)
            self.send_header("Content-Type", "text/html" if page else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    HTTPServer((host, port), Handler).serve_forever()
