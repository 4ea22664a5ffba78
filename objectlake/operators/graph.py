"""Edges: lookups, degrees, bounded traversal, integrity and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import cut

#: Hops up to which a traversal is one lazy plan; deeper ones cut their lineage at each hop and end when nothing new is found.
LAZY_HOPS = 4


def outgoing(edges: DataFrame, ids: list[str] | DataFrame, kind: str | None = None) -> DataFrame:
    return _at(edges, "src", ids, kind)


def incoming(edges: DataFrame, ids: list[str] | DataFrame, kind: str | None = None) -> DataFrame:
    return _at(edges, "dst", ids, kind)


def _at(edges: DataFrame, end: str, ids: list[str] | DataFrame, kind: str | None) -> DataFrame:
    found = edges.where(F.col("kind") == kind) if kind else edges
    if isinstance(ids, list):
        return found.where(F.col(end).isin(ids))
    return found.join(ids.select(F.col("object_id").alias(end)), end, "left_semi").select(edges.columns)


def appended(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new ones (src, dst, kind, strength, label), whose places follow the last one of their source, in the order of dst; the same edge may be there twice."""
    last = edges.groupBy("src").agg(F.max("pos").alias("last"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dst", "kind"))
    placed = new.withColumn("nth", nth).join(last, "src", "left").withColumn("pos", (F.coalesce("last", F.lit(-1)) + F.col("nth")).cast("int"))
    return edges.unionByName(placed.select(edges.columns))


def created(collections: DataFrame, names: DataFrame) -> DataFrame:
    """(collection_id, name) with those of the names that are new, numbered on from the greatest id, from 1 where there is none."""
    from objectlake.operators.lifecycle import sequenced

    top = collections.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("top"))
    fresh = sequenced(names.select("name").distinct().join(collections.select("name"), "name", "left_anti"), "name")
    return collections.unionByName(fresh.crossJoin(top).select((F.col("nth") + F.col("top")).cast("long").alias("collection_id"), "name"))  # top is one row


def degrees(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_id, n_out, n_in) of every object."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("object_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("object_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("object_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return objects.select("object_id").join(counted, "object_id", "left").select("object_id", zero("n_out"), zero("n_in"))


def traverse(edges: DataFrame, objects: DataFrame, starts: list[str] | DataFrame, kind: str | None = None, max_depth: int = 1) -> DataFrame:
    """(start, object_id, hops): each object that 1 to max_depth + 1 hops lead to, once, with the fewest hops.

    Targets that are no objects are left out and not gone through; a start only comes up if a cycle leads back to it.
    """
    spark = edges.sparkSession
    first = spark.createDataFrame([(s,) for s in starts], "object_id string") if isinstance(starts, list) else starts.select("object_id")
    links = (edges.where(F.col("kind") == kind) if kind else edges).select("src", "dst").distinct()
    links = links.join(objects.select(F.col("object_id").alias("dst")), "dst", "left_semi")
    lazy = max_depth < LAZY_HOPS
    links = links if lazy else cut(links)
    front = first.join(objects.select("object_id"), "object_id", "left_semi").distinct().select(F.col("object_id").alias("start"), "object_id")
    seen = None
    for hop in range(1, max_depth + 2):
        new = front.join(links, front.object_id == links.src).select("start", F.col("dst").alias("object_id")).distinct()
        if seen is not None:
            new = new.join(seen.select("start", "object_id"), ["start", "object_id"], "left_anti")
        new = new.withColumn("hops", F.lit(hop))
        if not lazy:
            new = cut(new)
            if new.isEmpty():
                break
        front = new.select("start", "object_id")
        seen = new if seen is None else seen.unionByName(new)
    return seen if seen is not None else front.withColumn("hops", F.lit(0)).limit(0)


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges whose target is no object."""
    return edges.join(objects.select(F.col("object_id").alias("dst")), "dst", "left_anti").select(edges.columns)


def repaired(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges without the dangling ones."""
    return edges.join(objects.select(F.col("object_id").alias("dst")), "dst", "left_semi").select(edges.columns)


def orphans(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects that nothing contains, without the root: the one of them that contains something, if it is the only one."""
    held = edges.where("kind = 'contains'")
    top = objects.select("object_id").join(held.select(F.col("dst").alias("object_id")), "object_id", "left_anti")
    roots = top.join(held.select(F.col("src").alias("object_id")), "object_id", "left_semi")
    only = roots.agg(F.count("*").alias("n"), F.min("object_id").alias("root")).where("n = 1").select(F.col("root").alias("object_id"))
    return top.join(only, "object_id", "left_anti")


def strong_neighbours(edges: DataFrame, above: float = 0.5) -> DataFrame:
    """Edges stronger than a limit, with their rank among those of the source: strongest first, then by position and target."""
    from pyspark.sql import Window

    order = Window.partitionBy("src").orderBy(F.desc("strength"), "pos", "dst", "kind")
    return edges.where(F.col("strength") > above).withColumn("rank", F.row_number().over(order))


def nodes(objects: DataFrame, attributes: DataFrame) -> DataFrame:
    """(object_id, name, node_group): the name or the first 8 characters of the id; directory, image, text or file."""
    from objectlake.schema import wide

    kinds = wide(attributes, {"name": "string", "content_type": "string", "__dir_index": "string"})
    group = F.when(F.col("__dir_index").isNotNull(), "directory").when(F.startswith("content_type", F.lit("image/")), "image").when(F.startswith("content_type", F.lit("text/")), "text").otherwise("file")
    return objects.select("object_id").join(kinds, "object_id", "left").select("object_id", F.coalesce("name", F.substring("object_id", 1, 8)).alias("name"), group.alias("node_group"))


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Collections with more members; one that is there already stays one."""
    return members.unionByName(new).dropDuplicates(["collection_id", "object_id"])


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["collection_id", "object_id"], "left_anti")


def signature(members: DataFrame, attributes: DataFrame) -> DataFrame:
    """(collection_id, name) of the attribute names that all members of a collection have."""
    size = members.groupBy("collection_id").agg(F.count("*").alias("size"))
    have = members.join(attributes.select("object_id", "name").distinct(), "object_id").groupBy("collection_id", "name").agg(F.count("*").alias("n"))
    return have.join(size, "collection_id").where("n = size").select("collection_id", "name")


def assemble(objects: DataFrame, attributes: DataFrame, edges: DataFrame) -> DataFrame:
    """Whole records: each object with its attributes in the order of names and its edges in their order."""
    a = attributes.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("name", "tag", "v_bool", "v_long", "v_double", "v_string", "v_binary", "v_ref"))).alias("attributes"))
    e = edges.groupBy(F.col("src").alias("object_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst", "kind", "strength"))).alias("edges"))
    return objects.join(a, "object_id", "left").join(e, "object_id", "left")
