"""Token ids as bytes: each document's id array compressed by itself with a shared zstandard dictionary.

Each document's ids, 16-bit where the vocabulary allows and 32-bit otherwise, little-endian, are serialized
once and kept by a checkpoint. A dictionary is then trained on all of them: each task trains one on every `stretch` bytes of its
documents, longer ones in pieces, and dictionaries are merged, FAN to one, by training on what they contain, until one is
left. With it, each document becomes one frame. Frames of a partition follow each other in a shard; the index keeps for each document the
shard, offset and length of its frame, its number of ids, and the hash of the dictionary, so that one
document is read by one seek and decompressed without its neighbours.

`frames` gives the index together with the frames; `write_store` puts them into files (one .bin a shard, the index as Parquet, the
dictionary beside it), and `read_document` reads from them. The folder can be on any file system that pyarrow knows.

Ids come from a byte-level BPE vocabulary of a public tokenizer. A text is split into the pieces that the
vocabulary's pattern defines, and ids of pieces are remembered (at most REMEMBER), which gives the ids of the whole text.

Defined cases: a null text has a null frame and length 0; an empty one a frame of no ids. Very long texts are one frame each. Where all texts together
are too few to train on, as in an empty table, there is no dictionary, its hash is empty, and frames are plain; an empty table has no frames.
Repeated rows each have a frame; ids may be null; neither order nor ties matter to a frame. The dictionary depends on how rows are
partitioned, what frames decode to doesn't. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm.bpe import _FAST, _FULL, _PLAIN
from objectlake.llm.common import cut, id_text, table, workers

VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Bytes of the dictionary; compression level; bytes of ids that one dictionary is trained on at a time, and of a piece of a document; dictionaries merged into one, and the bytes of a piece of them.
DICTIONARY_BYTES, LEVEL, STRETCH, PIECE, FAN, MERGED = 64 << 10, 3, 8 << 20, 16 << 10, 64, 512
REMEMBER = 500_000


class Encoder:
    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.one = tiktoken.Encoding("own", pat_str=_FULL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.type = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.full, self.seen = regex.compile(_FULL), {}

    def serialized(self, text: str) -> bytes:
        pieces = (_FAST if _PLAIN.fullmatch(text) else self.full).findall(text)
        seen = self.seen
        for p in set(pieces).difference(seen):
            seen[p] = np.array(self.one(p), self.type).tobytes()
        out = b"".join([seen[p] for p in pieces])
        if len(seen) > REMEMBER:
            seen.clear()
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def serialized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each document as bytes, from reliable storage."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if t is None else enc.serialized(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return cut(id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary"))


def _pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def _dictionary(samples: list[bytes], size: int, share: int) -> bytes | None:
    """A dictionary of the samples, of at most a share of their bytes; None where there are too few."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // share), samples, k=200, d=8, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return None


def _merged(rows: list[tuple[bool, list[bytes]]], size: int) -> tuple[bool, list[bytes]]:
    """(whether trained, the dictionary or the samples that are too few for one) of several such."""
    if len(rows) == 1 and rows[0][0]:
        return rows[0]
    samples = [p for trained, parts in rows for x in parts for p in (_pieces(x, MERGED) if trained else [x])]
    made = _dictionary(samples, size, 2 if any(trained for trained, _ in rows) else 8)
    if made is None and (dictionaries := [r for r in rows if r[0]]):
        return dictionaries[0]
    return (False, samples) if made is None else (True, [made])


def trained(ids: DataFrame, size: int = DICTIONARY_BYTES, stretch: int = STRETCH) -> bytes:
    """The dictionary of all ids; empty where they are too few for one."""
    workers(ids.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held, weight = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            made, parts = _merged([(False, held)], size)
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([nth], pa.int64()), pa.array([made]), pa.array([parts], pa.list_(pa.binary()))], names=["task", "nth", "trained", "parts"])

        for batch in batches:
            for data in batch.column("ids").to_pylist():
                for p in _pieces(data or b"", PIECE):
                    held.append(p)
                    weight += len(p)
                    if weight >= stretch:
                        yield row()
                        nth, held, weight = nth + 1, [], 0
        if held:
            yield row()

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("task", "nth", "trained", "parts"))))
        made, parts = _merged([r[2:] for r in rows], size)
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "nth": pa.array([0], pa.int64()), "trained": [made], "parts": pa.array([parts], pa.list_(pa.binary()))})

    schema = "task long, nth long, trained boolean, parts array<binary>"
    found = cut(ids.select("ids").mapInArrow(part, schema))
    while (n := found.count()) > FAN:
        found = cut(found.groupBy(F.pmod(F.xxhash64("task", "nth"), F.lit(2 * n // FAN + 1)).alias("to")).applyInArrow(merge, schema))
    rows = sorted((r.task, r.nth, r.trained, [bytes(p) for p in r.parts]) for r in found.collect())  # at most FAN dictionaries
    made, parts = _merged([r[2:] for r in rows], size) if rows else (False, [])
    return parts[0] if made else b""


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = DICTIONARY_BYTES, stretch: int = STRETCH) -> bytes:
    """The dictionary of all documents."""
    return trained(serialized(docs, id_col, text_col, vocabulary), size, stretch)


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest() if dictionary else ""


def compressed(ids: DataFrame, dictionary: bytes, vocabulary: str = VOCABULARY, level: int = LEVEL) -> DataFrame:
    """(doc_id, shard, offset, length, n_tokens, dictionary, frame) of serialized documents."""
    workers(ids.sparkSession)
    name = dictionary_hash(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(vocabulary).type.itemsize
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            done = [None if r is None else press.compress(r) for r in raw]
            size = np.array([len(f) if f is not None else 0 for f in done], np.int64)
            columns = [batch.column("doc_id"), pa.array(np.full(len(raw), shard, np.int32)), pa.array(at + np.cumsum(size) - size), pa.array(size), pa.array([None if r is None else len(r) // width for r in raw], pa.int32()), pa.array([name] * len(raw), pa.string()), pa.array(done, pa.binary())]
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "offset", "length", "n_tokens", "dictionary", "frame"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, shard int, offset long, length long, n_tokens int, dictionary string, frame binary")


def frames(docs: DataFrame, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, level: int = LEVEL) -> DataFrame:
    """compressed() of documents."""
    return compressed(serialized(docs, id_col, text_col, vocabulary), dictionary, vocabulary, level)


def ids(frame: bytes, dictionary: bytes, type_: str = "<u2") -> np.ndarray:
    """The ids in a frame."""
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress(frame), type_)


def _storage(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, level: int = LEVEL) -> str:
    """Write shards, index and dictionary under `folder`, which all executors must share; returns the dictionary's hash.

    A shard is written under another name and moved when whole, and a repeated task writes the same bytes, so that lost executors do no harm.
    """
    own = serialized(docs, id_col, text_col, vocabulary)
    dictionary = trained(own)
    files, at = _storage(folder)
    files.create_dir(at)
    with files.open_output_stream(f"{at}/dictionary") as file:
        file.write(dictionary)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _storage(folder)
        shard = TaskContext.get().partitionId()
        part = f"{at}/.{shard}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as file:
            for batch in batches:
                for f in batch.column("frame").to_pylist():
                    file.write(f or b"")
                yield batch.drop_columns(["frame"])
        files.move(part, f"{at}/{shard:05d}.bin")

    found = compressed(own, dictionary, vocabulary, level)
    found.mapInArrow(put, found.drop("frame").schema).write.mode("overwrite").parquet(f"{folder}/index")
    return dictionary_hash(dictionary)


def read_document(folder: str, doc_id: int, type_: str = "<u2") -> np.ndarray:
    """The ids of one document, by its index entry and one seek."""
    import pyarrow.dataset as ds

    files, at = _storage(folder)
    with files.open_input_stream(f"{at}/dictionary") as file:
        dictionary = file.read()
    row = ds.dataset(f"{at}/index", filesystem=files).to_table(filter=ds.field("doc_id") == doc_id).to_pylist()[0]
    if row["dictionary"] != dictionary_hash(dictionary):
        raise ValueError("the frame was made with another dictionary")
    with files.open_input_file(f"{at}/{row['shard']:05d}.bin") as file:
        file.seek(row["offset"])
        return ids(file.read(row["length"]), dictionary, type_)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = serialized(table(spark, sf_dir, "documents"))
    return compressed(ids, trained(ids))
