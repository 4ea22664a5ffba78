"""A store of objects in a directory tree, over a dataset: what the command line and the JSON answers are made of.

Each change is a commit of the tables that it touches; bulk work goes through Dataset and the operators directly.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.functions import text as T
from objectlake.operators import enrich, graph, integrity, namespace, stats, vectors, versions
from objectlake.plans.predicates import Contains, Eq, Predicate, Related, Semantic, Tables, compile
from objectlake.schema import ATTRIBUTES, EDGES, TAGS, wide
from objectlake.sources.dataset import Dataset

ROOT = "/"


def tag_of(value: Any) -> str:
    """The tag of a Python value."""
    for kind, tag in ((bool, "bool"), (int, "int64"), (float, "float64"), (str, "string"), (bytes, "binary"), (list, "vector")):
        if isinstance(value, kind):
            return tag
    return "null"


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.data = spark, Dataset(spark, path)

    def create(self) -> None:
        """Empty tables; a store that exists already is an error."""
        if self.data.versions():
            raise FileExistsError(self.data.path)
        self.data.commit(attributes=self.spark.createDataFrame([], ATTRIBUTES), edges=self.spark.createDataFrame([], EDGES))

    # what there is

    def attributes(self) -> DataFrame:
        return self.data.read("attributes")

    def edges(self) -> DataFrame:
        return self.data.read("edges")

    def objects(self) -> DataFrame:
        return self.attributes().select("object_id").distinct()

    def names(self) -> DataFrame:
        return self.attributes().where("name = 'name' and tag = 'string'").select("object_id", F.col("v_string").alias("name"))

    def texts(self) -> DataFrame:
        """(object_id, text): extracted text, else the name, else content that is a string."""
        all_ = wide(self.attributes(), {"_extracted_text": "string", "name": "string", "content": "string"})
        return all_.select("object_id", F.coalesce("_extracted_text", "name", "content").alias("text"))

    def get(self, object_id: str) -> dict[str, Any]:
        """The attributes of an object; a KeyError if there is none."""
        rows = self.attributes().where(F.col("object_id") == object_id).collect()
        if not rows:
            raise KeyError(object_id)
        value = lambda r: r[TAGS[r.tag][0]] if TAGS[r.tag] else None
        return {r.name: bytes(v) if isinstance(v := value(r), bytearray) else v for r in sorted(rows, key=lambda r: r.name)}

    def summaries(self, n: int = 100) -> DataFrame:
        """(object_id, name, content_type, modified_ns, n_attributes) of the n objects changed last."""
        per = self.attributes().groupBy("object_id").agg(F.max("meta.ts_ns").alias("modified_ns"), F.count("*").alias("n_attributes"))
        named = wide(self.attributes(), {"name": "string", "content_type": "string", "_detected_type": "string"})
        found = per.join(named, "object_id", "left").orderBy(F.desc("modified_ns"), "object_id").limit(n)
        return found.select("object_id", "name", F.coalesce("content_type", "_detected_type").alias("content_type"), "modified_ns", "n_attributes")

    def totals(self) -> dict[str, int]:
        size = F.coalesce(F.octet_length("v_string"), F.octet_length("v_binary"), F.lit(8))
        a = self.attributes().agg(F.count_distinct("object_id").alias("objects"), F.count("*").alias("attributes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).first()
        return a.asDict() | {"edges": self.edges().count(), "versions": len(self.data.versions()), "snapshots": self.data.snapshots().count()}

    # paths

    def entries(self, dir_id: str) -> DataFrame:
        return namespace.entries(self.edges().where(F.col("src") == dir_id), self.names())

    def resolve(self, path: str) -> str:
        """The object that a path leads to; a FileNotFoundError if none."""
        at = ROOT
        for part in path.split("/"):
            if part in ("", ".", ".."):
                continue
            found = self.entries(at).where(F.col("name") == part).first()
            if found is None:
                raise FileNotFoundError(path)
            at = found.object_id
        return at

    def _parent(self, path: str) -> tuple[str, str]:
        parts = [p for p in path.split("/") if p not in ("", ".", "..")]
        if not parts:
            raise ValueError(path)
        return self.resolve("/".join(parts[:-1])), parts[-1]

    def listing(self, path: str = "/") -> DataFrame:
        """(name, object_id, size) of a directory, names in byte order."""
        content = wide(self.attributes(), {"content": "binary"}).select("object_id", F.octet_length("content").alias("size"))
        return self.entries(self.resolve(path)).join(content, "object_id", "left").select("name", "object_id", "size").orderBy("name")

    # changes

    def put(self, object_id: str, values: dict[str, Any], more: DataFrame | None = None, **tables: DataFrame) -> None:
        """Write attributes of an object; others of it stay. Further tables are part of the same commit."""
        now = time.time_ns()
        rows = []
        for name, value in values.items():
            own = TAGS[tag_of(value)]
            rows.append((object_id, name, tag_of(value), *(value if own and own[0] == c else None for c, _ in (x for x in TAGS.values() if x)), (now, "store", 1.0, 1)))
        new = self.spark.createDataFrame(rows, ATTRIBUTES)
        base = self.attributes() if more is None else more
        self.data.commit(attributes=versions.upsert(base, new, ["object_id", "name"]), **tables)

    def make(self, path: str, values: dict[str, Any], kind: str = "file") -> str:
        """A new entry; its id. A name that is taken is a FileExistsError."""
        parent, name = self._parent(path)
        wanted = self.spark.createDataFrame([(parent, name)], "dir_id string, name string")
        edges, _ = namespace.make(self.edges(), self.names(), wanted, kind)
        own = wanted.select(namespace.new_id(kind, F.col("dir_id"), F.col("name")).alias("id")).first().id
        if self.entries(parent).where(F.col("name") == name).first() is not None:
            raise FileExistsError(path)
        self.put(own, {"name": name, "kind": kind} | values, edges=edges)
        return own

    def write(self, path: str, content: bytes) -> str:
        """The content of a file, which is made if it isn't there."""
        try:
            own = self.resolve(path)
        except FileNotFoundError:
            return self.make(path, {"content": content})
        self.put(own, {"content": content})
        return own

    def remove(self, path: str) -> None:
        """An entry with its object; a directory has to be empty."""
        own = self.resolve(path)
        gone = self.spark.createDataFrame([(own,)], "object_id string")
        if namespace.removable(self.edges(), gone).isEmpty():
            raise OSError(f"not empty: {path}")
        self.data.commit(attributes=versions.delete(self.attributes(), gone, ["object_id"]), edges=namespace.unlink(self.edges(), gone))

    def move(self, path: str, to: str) -> None:
        """Another place and name; what had that name is no longer reached."""
        own, (parent, name) = self.resolve(path), self._parent(to)
        edges, names = namespace.moved(self.edges(), self.names(), own, parent, name)
        self.put(own, {"name": name}, edges=edges)

    def bond(self, src: str, dst: str, kind: str = "related_to", strength: float = 1.0) -> None:
        new = self.spark.createDataFrame([(src, dst, kind, strength, None)], "src string, dst string, kind string, strength double, label string")
        self.data.commit(edges=graph.appended(self.edges(), new))

    def enrich(self) -> int:
        """Detected types, texts, tags, languages, quality and summaries of all objects with content; how many attributes were written."""
        content = wide(self.attributes(), {"name": "string", "content": "binary", "content_type": "string"}).where("content is not null")
        degree = self.edges().groupBy(F.col("src").alias("object_id")).agg(F.count("*").alias("n_edges"))
        found = enrich.enrich(content.join(degree, "object_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))))
        self.data.commit(attributes=versions.upsert(self.attributes(), found, ["object_id", "name"]))
        return self.attributes().where(F.startswith("name", F.lit("_"))).count()

    # questions

    def search(self, kind: str, q: str, name: str = "name") -> DataFrame:
        """Objects by equals, contains, related (two hops on) or semantic; other kinds are contains."""
        p: Predicate = {"equals": Eq(name, q), "related": Related(q, None, 2), "semantic": Semantic(q)}.get(kind, Contains(name, q))
        return compile(p, Tables(self.objects(), self.attributes(), self.edges(), self.texts()))

    def find(self, text: str, k: int = 10) -> DataFrame:
        return vectors.semantic_search(self.texts(), text, k)

    def similar(self, object_id: str, k: int = 5) -> DataFrame:
        return vectors.similar_to(self.texts(), object_id, k)

    def check(self) -> dict[str, Any]:
        """Counts of what is wrong, and problems of versions and snapshots."""
        root = self.spark.createDataFrame([(ROOT,)], "object_id string")
        return integrity.report(self.objects().unionByName(root), self.edges(), self.attributes()).first().asDict() | {"problems": self.data.problems()}

    def attribute_histogram(self) -> DataFrame:
        return stats.histogram(self.attributes(), "name", 20)

    def kind_histogram(self) -> DataFrame:
        return stats.histogram(self.edges(), "kind")

    def content_types(self) -> DataFrame:
        return wide(self.attributes(), {"content": "binary"}).select("object_id", T.content_type(F.col("content")).alias("content_type"))
