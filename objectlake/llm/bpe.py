"""Byte-level BPE with a public vocabulary, by recursive DuckDB queries inside each partition.

A text is split by the vocabulary's pattern; the distinct pieces of a stretch of texts become
rows (piece, position, token), one per byte. The recursive query joins neighbouring tokens with
the merge table, takes for each piece its leftmost pair of least rank, contracts it, and
goes on until no piece has a pair left. Pieces beyond SHORT bytes, which take one step for each of their
pairs that way, go through a second query that
contracts all occurrences of the least pair in a step, in rounds, so that even a text without
any space stays affordable. The result is the same: a contraction makes a token that merges of a higher rank only can
take up, so that the other occurrences of the pair are the least ones still (the tests hold both queries against
contraction one by one). Texts are put together from the ids of their pieces. Decoding joins
the ids with the vocabulary and aggregates in order.

Pieces already seen are remembered, at most REMEMBER of them, by each Python worker; that saves
time and never changes a result.

Defined cases: a null text has null tokens and null decoded text; an empty one has an empty list
and an empty text; an empty table gives an empty result. Of equal pairs in a piece the leftmost comes first. Ids can be null or repeated: rows are independent. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from objectlake.llm.common import id_text, table, workers

VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Bytes up to which a piece goes through the first query; characters of text in a stretch; pieces remembered; rounds' steps.
SHORT, STRETCH, REMEMBER, STEPS = 63, 2_500_000, 300_000, 24

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Texts of these characters only are split by `re`, which is faster; there, the two patterns mean the same.
_PLAIN = re.compile(rf"[\t-\r -~{_LETTERS}]*")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: k = piece * 64 + position of the token's first byte; nk, nt: key and id of the next token of the piece.
_SHORT_SQL = """
with recursive s(step, k, tok, nk, nt) as (
  select 0, k, tok, nk, nt from start
  union all
  select q.step + 1, q.k, case when q.k = b.hit then b.made else q.tok end,
    case when q.k = b.hit then b.nk2 else q.nk end,
    case when q.k = b.hit then b.nt2 when q.nk = b.hit then b.made else q.nt end
  from s q join (
    select c.*, e.nk as nk2, e.nt as nt2
    from (select k // 64 as piece, arg_min(k, code) as hit, arg_min(nk, code) as gone, arg_min(made, code) as made
          from (select p.k, p.nk, m.made, m.rank::bigint * 64 + p.k % 64 as code
                from s p join merges m on m.l = p.tok and m.r = p.nt)
          group by 1) c
    join s e on e.k = c.gone
  ) b on q.k // 64 = b.piece
  where q.k <> b.gone
)
select s.k // 64 as piece, list(tok order by s.k) as ids
from s join (select k // 64 as piece, max(step) as last from s group by 1) f on f.piece = s.k // 64 and f.last = s.step
group by 1
"""

#: All occurrences of the least pair at once; of overlapping ones (the pair of a token with itself) every other, from the left.
_LONG_SQL = f"""
with recursive s(step, piece, pos, tok) as (
  select 0, piece, pos, tok from start
  union all
  select step + 1, piece, pos, case when used then made else tok end
  from (
    select *, coalesce(lag(used) over (partition by piece order by nth), false) as eaten
    from (
      select *, coalesce(least_here and (l <> r or row_number() over (partition by piece, least_here, nth - run order by nth) % 2 = 1), false) as used
      from (
        select *, row_number() over (partition by piece, least_here order by nth) as run
        from (
          select *, rank = min(rank) over (partition by piece) as least_here, count(rank) over (partition by piece) as pairs
          from (select p.*, m.rank, m.made, m.l, m.r
                from (select *, lead(tok) over (partition by piece order by pos) as nxt, row_number() over (partition by piece order by pos) as nth from s) p
                left join merges m on m.l = p.tok and m.r = p.nxt)))))
  where not eaten and pairs > 0 and step < {STEPS}
)
select piece, pos, tok, last from (select *, max(step) over (partition by piece) as last from s) where step = last order by piece, pos
"""

_DECODE_SQL = "select doc, string_agg(v.hex, '' order by nth) as hex from ids join vocabulary v on v.id = ids.id group by doc"


class Bpe:
    """A vocabulary file of the tokenizers library's byte-level BPE kind, in a DuckDB connection of its own."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import duckdb

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves in the file, the others for U+0100 and on
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.byte_ids = np.zeros(256, np.int32)
        for char, b in byte_of.items():
            self.byte_ids[b] = vocab[char]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._put("merges", l=[vocab[a] for a, _ in pairs], r=[vocab[b] for _, b in pairs], rank=range(len(pairs)), made=[vocab[a + b] for a, b in pairs])
        plain = {t: i for t, i in vocab.items() if all(c in byte_of for c in t)}
        self._put("vocabulary", id=list(plain.values()), hex=[bytes(byte_of[c] for c in t).hex() for t in plain])
        self.seen: dict[str, bytes] = {}
        self.full = None

    def _put(self, name: str, **columns) -> None:
        arrays = {k: pa.array(v, pa.string() if k == "hex" else pa.int32()) for k, v in columns.items()}
        self.con.register("incoming", pa.table(arrays))
        self.con.execute(f"create table {name} as select * from incoming")
        self.con.unregister("incoming")

    def _query(self, sql: str, name: str, rows: dict) -> pa.Table:
        self.con.register(name, pa.table(rows))
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _FAST.findall(text)
        if self.full is None:
            import regex

            self.full = regex.compile(_FULL)
        return self.full.findall(text)

    def pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids as little-endian 32-bit numbers."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        short = [i for i, b in enumerate(raw) if len(b) <= SHORT]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            size = np.fromiter((len(raw[i]) for i in part), np.int64, len(part))
            tok = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
            last = np.cumsum(size) - 1
            k = np.repeat(np.arange(len(part)) * 64 - (last + 1 - size), size) + np.arange(len(tok))
            nk, nt = np.r_[k[1:], -1], np.r_[tok[1:], -1].astype(np.int32)
            nk[last], nt[last] = -1, -1
            out = self._query(_SHORT_SQL, "start", {"k": k, "tok": tok, "nk": nk, "nt": nt})
            ids = out.column("ids").combine_chunks()
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(), ids.offsets.to_numpy() * 4
            for n, piece in enumerate(out.column("piece").to_pylist()):
                yield pieces[part[piece]], flat[ends[n] : ends[n + 1]]
        for i in (i for i, b in enumerate(raw) if len(b) > SHORT):
            tok = self.byte_ids[np.frombuffer(raw[i], np.uint8)]
            while True:
                out = self._query(_LONG_SQL, "start", {"piece": np.zeros(len(tok), np.int32), "pos": np.arange(len(tok)), "tok": tok})
                tok = out.column("tok").to_numpy().astype(np.int32)
                if out.column("last")[0].as_py() < STEPS:
                    break
            yield pieces[i], tok.astype("<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(texts):
            split, chars = [], 0
            while at < len(texts) and (not split or chars < STRETCH):
                split.append(None if texts[at] is None else self.split(texts[at]))
                chars += len(texts[at] or "")
                at += 1
            known = self.seen
            new = list(dict.fromkeys(p for ps in split if ps for p in ps if p not in known))
            if len(known) + len(new) > REMEMBER:
                known = self.seen = {}
                new = list(dict.fromkeys(p for ps in split if ps for p in ps))
            known.update(self.pieces(new))
            out += [None if ps is None else np.frombuffer(b"".join(map(known.__getitem__, ps)), "<i4") for ps in split]
            if len(known) > REMEMBER:
                self.seen = {}
        return out

    def decode(self, ids: list[np.ndarray | None]) -> list[str | None]:
        out: list[str | None] = [None if x is None else "" for x in ids]
        at = 0
        while at < len(ids):
            part, n = [], 0
            while at < len(ids) and (not part or n < 250_000):
                if ids[at] is not None and len(ids[at]):
                    part.append(at)
                    n += len(ids[at])
                at += 1
            if part:
                flat = np.concatenate([ids[i] for i in part]).astype(np.int32)
                doc = np.repeat(np.array(part, np.int32), [len(ids[i]) for i in part])
                got = self._query(_DECODE_SQL, "ids", {"doc": doc, "nth": np.arange(len(flat), dtype=np.int32), "id": flat})
                for d, h in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist()):
                    out[d] = bytes.fromhex(h).decode("utf-8", "replace")
        return out


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _map(df: DataFrame, column: str, step, schema: str) -> DataFrame:
    workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from step(batch.column("doc_id"), batch.column(column))

    return df.mapInArrow(run, schema)


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    size = [0 if x is None else len(x) for x in ids]
    offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.array([x is None for x in ids] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens)."""

    def step(doc_id: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        ids = loaded(vocabulary).encode(texts.to_pylist())
        yield pa.RecordBatch.from_arrays([doc_id, pa.array([None if x is None else len(x) for x in ids], pa.int32()), _lists(ids)], names=["doc_id", "n_tokens", "tokens"])

    return _map(id_text(docs, id_col, text_col), "text", step, "doc_id long, n_tokens int, tokens array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text). Ids that the vocabulary lacks are left out."""
    from pyspark.sql import functions as F

    def step(doc_id: pa.Array, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
        ids = [None if x is None else np.array([i for i in x if i is not None], np.int32) for x in tokens.to_pylist()]
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(loaded(vocabulary).decode(ids), pa.string())], names=["doc_id", "text"])

    return _map(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens")), "tokens", step, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, text): the ids and the text that they decode to, in one pass."""

    def step(doc_id: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        ids = bpe.encode(texts.to_pylist())
        columns = [doc_id, pa.array([None if x is None else len(x) for x in ids], pa.int32()), _lists(ids), pa.array(bpe.decode(ids), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "tokens", "text"])

    return _map(id_text(docs, id_col, text_col), "text", step, "doc_id long, n_tokens int, tokens array<int>, text string")


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
