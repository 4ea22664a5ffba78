"""Paths over the edges that contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.session import cut


def entries(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(dir_id, name, object_id): of children with the same name the one added last."""
    held = edges.where("kind = 'contains'").join(names.select(F.col("object_id").alias("dst"), "name"), "dst")
    return held.groupBy(F.col("src").alias("dir_id"), "name").agg(F.max_by("dst", F.struct("pos", "dst")).alias("object_id"))


def paths(edges: DataFrame, names: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, object_id, depth) of everything below the roots; level by level, without a bound each cut from its lineage until a level is empty."""
    index = entries(edges, names)
    index = index if max_depth is not None else cut(index)
    level = roots.join(names, "object_id").select(F.concat(F.lit("/"), F.col("name")).alias("path"), "object_id", F.lit(0).alias("depth"))
    found, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.select("path", F.col("object_id").alias("dir_id")).join(index, "dir_id").select(F.concat("path", F.lit("/"), "name").alias("path"), "object_id", F.lit(depth).alias("depth"))
        if max_depth is None:
            level = cut(level)
            if level.isEmpty():
                break
        found = found.unionByName(level)
    return found


def normalized(path: Column) -> Column:
    """Without empty, . and .. components: .. does nothing."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", "..")), "/"))


def lookup(all_paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, object_id) of a column `path`; without a row for those that lead nowhere."""
    return wanted.select(F.col("path").alias("wanted"), normalized(F.col("path")).alias("path")).join(all_paths.select("path", "object_id"), "path").select("wanted", "object_id")


def readdir(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(dir_id, pos, name, object_id, is_dir): . and .. first, then names in byte order; only what contains something is a directory."""
    from pyspark.sql import Window

    index = entries(edges, names)
    dirs = edges.where("kind = 'contains'").select(F.col("src").alias("object_id")).distinct().withColumn("is_dir", F.lit(True))
    listed = index.join(dirs, "object_id", "left").select("dir_id", (F.row_number().over(Window.partitionBy("dir_id").orderBy("name")) + 1).alias("pos"), "name", "object_id", F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
    own = dirs.select(F.col("object_id").alias("dir_id"))
    dot = own.select("dir_id", F.lit(0).alias("pos"), F.lit(".").alias("name"), F.col("dir_id").alias("object_id"), F.lit(True).alias("is_dir"))
    up = own.select("dir_id", F.lit(1).alias("pos"), F.lit("..").alias("name"), F.lit("/").alias("object_id"), F.lit(True).alias("is_dir"))
    return dot.unionByName(up).unionByName(listed)


def stat(content: DataFrame) -> DataFrame:
    """(object_id, size, blocks, mode) of (object_id, content, is_dir): blocks of 512 bytes."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return content.select("object_id", size.cast("long").alias("size"), F.ceil(size / 512).cast("long").alias("blocks"), F.when(F.col("is_dir"), 0o040755).otherwise(0o100644).alias("mode"))


def usage(all_paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, files, bytes) of each path with all below it. sizes: object_id, size."""
    sized = all_paths.join(sizes, "object_id", "left").select("path", F.coalesce("size", F.lit(0)).alias("size"), F.col("size").isNotNull().cast("int").alias("file"))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return sized.select(F.explode(above).alias("path"), "size", "file").groupBy("path").agg(F.sum("file").cast("long").alias("files"), F.sum("size").cast("long").alias("bytes"))


def splice(content: Column, offset: int, data: bytes) -> Column:
    """Bytes written at an offset; a gap is filled with zeros."""
    raw, new = content.cast("binary"), F.lit(bytearray(data))
    head = F.rpad(F.substring(raw, 1, offset), offset, F.lit(bytearray(b"\0"))) if offset else F.lit(bytearray())
    return F.concat(head, new, F.substr(raw, F.lit(offset + len(data) + 1)))


def truncated(content: Column, size: int) -> Column:
    return F.rpad(F.substring(content.cast("binary"), 1, size), size, F.lit(bytearray(b"\0"))) if size else F.lit(bytearray())


def read_at(content: Column, offset: int, size: int) -> Column:
    """At most `size` bytes from an offset on; none beyond the end."""
    return F.substring(content.cast("binary"), offset + 1, size)


def with_attributes(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """(object_id, mode, size, blocks, mtime_ns) with what `changes` sets; null leaves it as it is."""
    both = stats.join(changes.select("object_id", *[F.col(c).alias(f"__{c}") for c in ("mode", "size", "mtime_ns")]), "object_id", "left")
    own = {c: F.coalesce(f"__{c}", c) for c in ("mode", "size", "mtime_ns")}
    return both.select("object_id", own["mode"].alias("mode"), own["size"].alias("size"), F.ceil(own["size"] / 512).cast("long").alias("blocks"), own["mtime_ns"].alias("mtime_ns"))


FILE_TYPES = {"file": "-", "dir": "d", "symlink": "l", "fifo": "p", "block": "b", "char": "c"}


def file_type(code: Column) -> Column:
    """The type with a numeric code; null for others."""
    return F.try_element_at(F.array(*map(F.lit, FILE_TYPES)), (code + 1).cast("int"))


def shown_mode(kind: Column, bits: Column) -> Column:
    """A type and nine bits as they are listed: drwxr-xr-x."""
    first = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])[kind]
    each = [F.when(bits.bitwiseAND(1 << i) > 0, "xwr"[i % 3]).otherwise("-") for i in range(8, -1, -1)]
    return F.concat(first, *each)


def new_id(kind: str, parent: Column, name: Column) -> Column:
    """The id of a directory ("dir") or file ("file") that is made in a parent."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), parent, F.lit("/"), name), 256)


def make(edges: DataFrame, names: DataFrame, wanted: DataFrame, kind: str = "file") -> tuple[DataFrame, DataFrame]:
    """(edges, names) with new entries (dir_id, name); names that are empty, have a slash or exist already are left out."""
    fresh = wanted.where((F.col("name") != "") & ~F.contains(F.col("name"), F.lit("/"))).distinct().join(entries(edges, names).select("dir_id", "name"), ["dir_id", "name"], "left_anti")
    made = fresh.withColumn("object_id", new_id(kind, F.col("dir_id"), F.col("name")))
    last = edges.groupBy(F.col("src").alias("dir_id")).agg(F.max("pos").alias("last"))
    links = made.join(last, "dir_id", "left").select(F.col("dir_id").alias("src"), (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("pos"), F.col("object_id").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("label"))
    return edges.unionByName(links), names.unionByName(made.select("object_id", "name"))


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that lead to the objects that go."""
    return edges.join(gone.select(F.col("object_id").alias("dst")), "dst", "left_anti").select(edges.columns)


def removable(edges: DataFrame, dirs: DataFrame) -> DataFrame:
    """The directories of `dirs` that contain nothing, and so can be removed."""
    return dirs.join(edges.where("kind = 'contains'").select(F.col("src").alias("object_id")), "object_id", "left_anti")


def moved(edges: DataFrame, names: DataFrame, object_id: str, to_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(edges, names) with an object in another directory, under another name; what had that name there is no longer reached."""
    there = entries(edges, names).where((F.col("dir_id") == to_dir) & (F.col("name") == name)).select(F.col("dir_id").alias("src"), F.col("object_id").alias("dst"))
    left = edges.join(there.where(F.col("dst") != object_id), ["src", "dst"], "left_anti").select(edges.columns)
    own = (F.col("dst") == object_id) & (F.col("kind") == "contains")
    return left.withColumn("src", F.when(own, to_dir).otherwise(F.col("src"))), names.withColumn("name", F.when(F.col("object_id") == object_id, name).otherwise(F.col("name")))
