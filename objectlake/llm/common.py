"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")

#: A table is broadcast, or held whole by each Python worker, only below this many bytes;
#: past it, the operators go through it in slices of this size.
SIDE_BYTES = 64 << 20


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; none for null."""
    if not text:
        return []
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def spans(text: str) -> list[tuple[int, int]]:
    """Where words(text) are."""
    return [m.span() for m in WORD.finditer(text)]


def keep_rows(docs: DataFrame, mask: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """docs' rows, with all columns, for which the function of a batch says so; nothing is shuffled."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def least(df: DataFrame, key: str, n: int, *ties: str) -> list[Row]:
    """The n rows with the least hash of `key`, then by `ties`. Only about n rows leave the tasks, however many there are: those below a bound that follows from the count."""
    h, share = F.xxhash64(key), (n + 4 * math.sqrt(n) + 16) / max(1, df.count())
    while True:
        part = df if share >= 1 else df.where(h < int(share * 2**64) - 2**63)
        rows = part.orderBy(h, key, *ties).limit(n).collect()
        if len(rows) == n or share >= 1:
            return rows
        share *= 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package from wherever the driver did."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # the default lets a batch of long texts fill memory
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (root, env.get("PYTHONPATH", ""))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else one that is set here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that returns a dict of columns for `schema`, or None."""
    workers(df.sparkSession)
    target = T.StructType.fromDDL(schema)
    fields = [(f.name, f.dataType) for f in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in fields])
        for batch in batches:
            if (out := step(batch)) is not None:
                columns = [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, target)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under names of its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
