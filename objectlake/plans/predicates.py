"""A small algebra of questions about objects, compiled into one DataFrame each."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.operators import graph, vectors
from objectlake.schema import TAGS, read_as


class Predicate:
    def __and__(self, other: Predicate) -> And:
        return And((self, other))

    def __or__(self, other: Predicate) -> Or:
        return Or((self, other))


@dataclass(frozen=True)
class Eq(Predicate):
    """The attribute has this tag and value; with `meta` (a dict), exactly this provenance too."""

    name: str
    value: Any
    tag: str = "string"
    meta: dict | None = None


@dataclass(frozen=True)
class Contains(Predicate):
    """The attribute is a string with this substring, case and all."""

    name: str
    part: str


@dataclass(frozen=True)
class Related(Predicate):
    """Reached from an object along edges, at most depth + 1 hops away."""

    object_id: str
    kind: str | None = None
    depth: int = 1


@dataclass(frozen=True)
class Semantic(Predicate):
    """Among the k objects whose text is nearest to a query."""

    query: str
    k: int = 10


@dataclass(frozen=True)
class SimilarTo(Predicate):
    """Among the k objects whose text is nearest to that of an object, without itself."""

    object_id: str
    k: int = 5


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = field(default=())


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = field(default=())


@dataclass
class Tables:
    objects: DataFrame
    attributes: DataFrame
    edges: DataFrame | None = None
    texts: DataFrame | None = None  # object_id, text


def condition(p: Predicate) -> Column | None:
    """The test of one attribute row, for the predicates that are one."""
    if isinstance(p, Eq):
        test = (F.col("name") == p.name) & (F.col("tag") == p.tag)
        if TAGS[p.tag]:
            test = test & read_as(p.tag).eqNullSafe(F.lit(p.value).cast(TAGS[p.tag][1]))
        for k, v in (p.meta or {}).items():
            test = test & F.col(f"meta.{k}").eqNullSafe(F.lit(v))
        return test
    if isinstance(p, Contains):
        return (F.col("name") == p.name) & (F.col("tag") == "string") & F.contains(F.col("v_string"), F.lit(p.part))
    return None


def compile(p: Predicate, t: Tables) -> DataFrame:
    """(object_id) of the objects that meet the predicate, each once."""
    if (test := condition(p)) is not None:
        return t.attributes.where(test).select("object_id").distinct()
    if isinstance(p, Related):
        return graph.traverse(t.edges, t.objects, [p.object_id], p.kind, p.depth).select("object_id").distinct()
    if isinstance(p, Semantic):
        return vectors.semantic_search(t.texts, p.query, p.k).select("object_id")
    if isinstance(p, SimilarTo):
        return vectors.similar_to(t.texts, p.object_id, p.k).select("object_id")
    if isinstance(p, Or):
        # tests of rows are one scan; the rest is united with it
        tests = [c for x in p.parts if (c := condition(x)) is not None]
        found = [t.attributes.where(reduce(Column.__or__, tests)).select("object_id")] if tests else []
        found += [compile(x, t) for x in p.parts if condition(x) is None]
        return reduce(DataFrame.unionByName, found).distinct() if found else t.objects.select("object_id").limit(0)
    if isinstance(p, And):
        # tests of rows are one scan and one aggregation, of the names that they are about; the rest are semi joins
        tests = [(x, c) for x in p.parts if (c := condition(x)) is not None]
        rest = [compile(x, t) for x in p.parts if condition(x) is None]
        if tests:
            each = t.attributes.where(reduce(Column.__or__, [c for _, c in tests])).groupBy("object_id").agg(*[F.bool_or(c).alias(f"t{n}") for n, (_, c) in enumerate(tests)])
            found = each.where(reduce(Column.__and__, [F.col(f"t{n}") for n in range(len(tests))])).select("object_id")
        else:
            found = t.objects.select("object_id")
        return reduce(lambda a, b: a.join(b, "object_id", "left_semi"), rest, found)
    raise TypeError(p)


def compile_wide(p: Predicate, rows: DataFrame) -> DataFrame:
    """The rows of an ordinary table, a column for each attribute, that meet a predicate of tests, And and Or: one filter, pushed to the scan."""

    def test(x: Predicate) -> Column:
        if isinstance(x, Eq):
            return F.col(x.name).eqNullSafe(F.lit(x.value))
        if isinstance(x, Contains):
            return F.coalesce(F.contains(F.col(x.name), F.lit(x.part)), F.lit(False))
        if isinstance(x, And):
            return reduce(Column.__and__, map(test, x.parts), F.lit(True))
        if isinstance(x, Or):
            return reduce(Column.__or__, map(test, x.parts), F.lit(False))
        raise TypeError(x)

    return rows.where(test(p))
