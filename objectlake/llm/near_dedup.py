"""Near-duplicate groups: 128-bit SimHash fingerprints joined with themselves in binary tries.

A fingerprint sums the bits of each distinct word, weighted by the square root of its count
times its length (at most 8), so that short function words count little. Equal
fingerprints are merged first. Every fingerprint then goes into several tries, each with its own
order of the bits; a trie is cut at its first bits into shards of about `shard` fingerprints. Within
a shard, pairs of nodes are walked down together, the differing bits of a pair are added up, and a
pair is left as soon as its error budget is spent: one or two bits (ERRORS) down to the depth at which
random fingerprints part (the logarithm of their number), and `radius` bits from there on.
Of the pairs found in a shard only a spanning forest leaves the task, and connected
components of these edges are the groups. Pairs of nodes that earlier pairs have connected already are not walked.

Recall: the number of tries follows from the number of fingerprints, so that a pair of documents right at the
radius, the hardest one, meets within the budgets of at least one trie with a probability of RECALL, at every
size of table (nearer pairs with a higher one). A guarantee for every single pair isn't affordable at
this radius: it takes tries without a budget, which compare nearly all pairs.

A shard that many similar texts make larger than `hot` times `shard` is cut at random into parts, and
each pair of parts is a task, so that no task holds more than two parts and no pair is lost.

Defined cases: a null, empty or wordless text has no fingerprint and is in no group. Very long texts are
read whole. Repeated rows are copies of each other, also if they carry the same id. In a group the row with the least
doc_id stays (null counts as the greatest); of several with that id the one with the least hash of
its columns, then the least fingerprint; of rows equal in all of these any, as they are the same. An empty table gives an empty result.
Other columns of the input are not read and can have any name; keep_one tells rows apart by all of their columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlake.llm.common import cut, id_text, map_arrow, table, words, workers

BITS = 128
#: Pairs of documents whose fingerprints differ in at most this many bits are near copies (a word in ten replaced gives 16 on average, hardly ever more than 22).
RADIUS = 22
#: Share to be found of the pairs right at the radius.
RECALL = 0.9999
#: Fingerprints in a shard of a trie, and differing bits of a pair down to where random fingerprints part: up to LARGE fingerprints, and beyond, where fewer and dearer tries save most of the shuffle.
SHARD, ERRORS = (1 << 18, 1 << 20), (1, 2)
LARGE = 1 << 27
#: A shard that is larger by this factor is cut into parts.
HOT = 2


def fingerprint(text: str | None) -> bytes | None:
    """The 16 bytes of the SimHash; None without words."""
    counts = Counter(words(text))
    if not counts:
        return None
    total, weight = np.zeros(BITS), 0.0
    keys = list(counts)
    for i in range(0, len(keys), 8192):
        part = keys[i : i + 8192]
        w = np.sqrt(np.fromiter((counts[k] for k in part), float, len(part)))
        w = np.rint(w * np.minimum(np.fromiter(map(len, part), float, len(part)), 8) * 16)  # whole numbers: the order of words can't matter
        digests = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "replace")) for k in part)
        total += w @ np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).astype(float)
        weight += w.sum()
    return np.packbits(2 * total > weight).tobytes()


class Plan:
    """The tries for n fingerprints: bits of a shard's key, depth to which the error budget holds, and the order of bits of each trie."""

    def __init__(self, n: int, radius: int = RADIUS, recall: float = RECALL, errors: int | None = None, shard: int | None = None) -> None:
        if not 0 <= radius <= BITS:
            raise ValueError(f"a radius of {radius} bits")
        n = max(n, 2)
        errors, shard = ERRORS[n > LARGE] if errors is None else errors, SHARD[n > LARGE] if shard is None else shard
        self.shard = shard
        self.radius, self.errors = radius, min(errors, radius)
        self.head = max(0, math.ceil(math.log2(n / shard)))
        self.depth = max(self.head, math.ceil(math.log2(n)))
        #: of a pair at the radius, for one trie: no differing bit in the key and at most `errors` down to `depth`
        equal = math.prod(max(0, BITS - radius - i) / (BITS - i) for i in range(self.head))
        self.chance = equal * sum(math.comb(radius, e) * math.comb(max(0, BITS - radius - self.head), self.depth - self.head - e) for e in range(min(self.errors, self.depth - self.head) + 1)) / math.comb(BITS - self.head, self.depth - self.head)
        if self.chance <= 0:
            raise ValueError(f"no trie finds pairs at a radius of {radius} bits")
        count = 1 if self.chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - self.chance))
        rng = np.random.default_rng(self.depth)
        each = BITS // self.depth  # a permutation, turned by `depth` bits each time, serves several tries: their first bits have nothing in common
        turns = [(rng.permutation(BITS), t) for _ in range(-(-count // each)) for t in range(each)]
        perms: dict[int, np.ndarray] = {}
        self.orders: list[np.ndarray] = []
        for perm, t in turns[:count]:
            self.orders.append(np.roll(perms.setdefault(len(self.orders) - t, perm), -t * self.depth))


class _Groups:
    """Groups of rows that pairs connect, and the pairs that did so."""

    def __init__(self, n: int) -> None:
        self.edges: list[tuple[int, int]] = []
        self.name, self.breaks = np.arange(n), None

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        fresh = self.name[i] != self.name[j]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for a, b, ra, rb in zip(*(x[fresh].tolist() for x in (i, j, self.name[i], self.name[j]))):
            ra, rb = root(ra), root(rb)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                self.edges.append((a, b))
        if up:
            move = np.arange(len(self.name))
            move[list(up)] = [root(x) for x in up]
            self.name, self.breaks = move[self.name], None

    def apart(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether the rows a0:a1 and b0:b1 aren't all in one group."""
        if self.breaks is None:
            self.breaks = np.r_[0, 0, np.cumsum(self.name[1:] != self.name[:-1])]
        s = self.breaks
        return (s[a1] != s[a0 + 1]) | (s[b1] != s[b0 + 1]) | (self.name[a0] != self.name[b0])


class Trie:
    """Distinct sorted fingerprints, equal in their first `head` bits, joined with themselves."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, head: int, depth: int, errors: int, radius: int, side: np.ndarray | None = None) -> None:
        """hi, lo: fingerprints as pairs of 64-bit numbers; side: a mark of each (two parts of a shard that is cut), where pairs of the same mark don't count."""
        self.hi, self.lo, self.head, self.depth, self.errors, self.radius, self.side = hi, lo, head, depth, errors, radius, side
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.groups: _Groups | None = None

    def _bit(self, rows: np.ndarray, d: int) -> np.ndarray:
        return ((self.hi if d < 64 else self.lo)[rows] >> np.uint64(63 - d % 64)) & np.uint64(1)

    def _level(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first rows of the nodes at depth d and the number of rows, children of each node where the bit is 0 and 1, or -1)."""
        if d not in self.levels:
            n, differ = len(self.hi), self.hi[1:] ^ self.hi[:-1]
            here = np.flatnonzero(np.r_[True, (differ >> np.uint64(64 - d)) > 0 if d else np.zeros(n - 1, bool)])
            below = np.cumsum(np.r_[0, (differ >> np.uint64(63 - d)) > 0]).astype(np.int32)
            ends = np.r_[here[1:], n] - 1
            self.levels[d] = np.r_[here, n].astype(np.int32), np.where(self._bit(here, d) == 0, below[here], np.int32(-1)), np.where(self._bit(ends, d) == 1, below[ends], np.int32(-1))
        return self.levels[d]

    def _middle(self, a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
        """Where in the rows a:b bit d becomes 1."""
        while len(open_ := np.flatnonzero(a < b)):
            m = (a[open_] + b[open_]) // 2
            one = self._bit(m, d) == 1
            a, b = a.copy(), b.copy()
            b[open_[one]], a[open_[~one]] = m[one], m[~one] + 1
        return a

    def _near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows that count."""
        go = i != j
        if self.side is not None:
            go &= self.side[i] != self.side[j]
        if self.groups is not None and self.groups.edges:
            go &= self.groups.name[i] != self.groups.name[j]
        i, j = i[go], j[go]
        d = np.bitwise_count(self.hi[i] ^ self.hi[j])
        some = np.flatnonzero(d <= self.radius)
        i, j = i[some], j[some]
        go = d[some] + np.bitwise_count(self.lo[i] ^ self.lo[j]) <= self.radius
        return i[go], j[go]

    def _found(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = self._near(i, j)
        if len(i):
            if self.groups is not None:
                self.groups.add(i, j)
            yield i, j

    def _deep(self, d: int, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The walk below `depth`; pairs: rows a0:a1 and b0:b1, differing bits so far."""
        stack = [(d, pairs)]
        while stack:
            d, pairs = stack.pop()
            if self.groups is not None:
                pairs = pairs[:, self.groups.apart(*pairs[:4])]
            if pairs.shape[1] > 1 << 14:
                stack += [(d, x) for x in np.array_split(pairs, 2, axis=1)[::-1]]
                continue
            a0, a1, b0, b1, off = pairs
            small = (a1 - a0) * (b1 - b0) <= 64
            if small.any() or d == BITS:
                a, b, m, k = a0[small], b0[small], (a1 - a0)[small], (b1 - b0)[small]
                which = np.repeat(np.arange(len(a)), m * k)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(m * k) - m * k, m * k)
                i, j = a[which] + nth // k[which], b[which] + nth % k[which]
                once = (a != b)[which] | (i < j)
                yield from self._found(i[once], j[once])
            a0, a1, b0, b1, off = pairs = pairs[:, ~small]
            if not pairs.shape[1] or d == BITS:
                continue
            am, bm, same = self._middle(a0, a1, d), self._middle(b0, b1, d), a0 == b0
            down = np.concatenate([np.stack(x) for x in ((a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1))] + [np.stack((am, a1, b0, bm, off + 1))[:, ~same]], axis=1)
            down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= self.radius)]
            if down.shape[1]:
                stack.append((d + 1, down))

    def pairs(self, groups: _Groups | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that differ in at most `radius` bits, and in at most `errors` of the first `depth`; with groups, which take them up, only such as connect what isn't."""
        self.groups = groups
        stack = [(self.head, np.zeros(1, np.int32), np.zeros(1, np.int32), 0)]
        while stack:
            d, x, y, off = stack.pop()
            first, zero, one = self._level(d)
            if groups is not None and 8 * len(groups.edges) > len(self.hi):
                go = groups.apart(first[x], first[x + 1], first[y], first[y + 1])
                x, y = x[go], y[go]
            if len(x) > 1 << 17:  # halves, so that memory stays bounded
                m = len(x) // 2
                stack += [(d, x[m:], y[m:], off), (d, x[:m], y[:m], off)]
                continue
            if d == self.depth:
                i, j = first[x], first[y]
                ends_i, ends_j = first[x + 1], first[y + 1]
                single = ends_i - i + ends_j - j == 2
                yield from self._found(i[single], j[single])
                if not single.all():
                    several = ~single
                    yield from self._deep(d, np.stack([i[several], ends_i[several], j[several], ends_j[several], np.full(int(several.sum()), off)]).astype(np.int64))
                continue
            zx, zy, ox, oy = zero[x], zero[y], one[x], one[y]
            zeros, ones = (zx | zy) >= 0, (ox | oy) >= 0  # a missing child is -1
            downs = [(np.r_[zx[zeros], ox[ones]], np.r_[zy[zeros], oy[ones]], off)]
            if off < self.errors:
                across, back = (zx | oy) >= 0, (ox | zy) >= 0
                if not off:  # a node with itself has one pair of unlike children
                    back &= x != y
                downs.append((np.r_[zx[across], ox[back]], np.r_[oy[across], zy[back]], off + 1))
            stack += [(d + 1, *down) for down in downs if len(down[0])]


def _permuted(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes with their bits in another order."""
    return np.ascontiguousarray(np.packbits(np.unpackbits(raw, axis=1)[:, order], axis=1))


def _shard_pairs(raw: np.ndarray, order: np.ndarray, plan: Plan, side: np.ndarray | None) -> pa.RecordBatch | None:
    """Edges within a shard; raw: rows of 16 bytes in their own order."""
    if len(raw) < 2:
        return None
    turned = _permuted(raw, order).view(">u8").astype(np.uint64)
    by = np.lexsort((turned[:, 1], turned[:, 0]))
    groups = _Groups(len(raw))
    for _ in Trie(np.ascontiguousarray(turned[by, 0]), np.ascontiguousarray(turned[by, 1]), plan.head, plan.depth, plan.errors, plan.radius, None if side is None else side[by]).pairs(groups):
        pass
    if not groups.edges:
        return None
    ends = by[np.array(groups.edges)]
    return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in raw[ends[:, k]]], pa.binary()) for k in (0, 1)], names=["a", "b"])


def edges(prints: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, shard: int | None = None, hot: int = HOT) -> DataFrame:
    """(a, b): a spanning set of the pairs of distinct fingerprints `fp` within the radius; n: about how many there are."""
    spark = prints.sparkSession
    workers(spark)
    plan = Plan(n, radius, recall, shard=shard)
    trees, shard = len(plan.orders), plan.shard

    def heads(raw: np.ndarray) -> Iterator[np.ndarray]:
        """The shard of each fingerprint, for one trie after the other."""
        for tree, order in enumerate(plan.orders):
            key = np.full(len(raw), tree, np.int64)
            for bit in order[: plan.head].tolist():
                key = key << 1 | raw[:, bit >> 3] >> (7 - (bit & 7)) & 1
            yield key

    # so many fingerprints at a time that several of them share a row of each shard
    together = min(1 << 22, max(1 << 16, 16 << plan.head))

    def read(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
        held, size = [], 0
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 16))
            size += len(held[-1])
            if size >= rows:
                yield np.concatenate(held)
                held, size = [], 0
        if size:
            yield np.concatenate(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in read(batches, together):
            keys, sizes = np.unique(np.concatenate(list(heads(raw))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes)], names=["key", "n"])

    # shards beyond `hot` times their size, at most n * trees / (hot * shard) of them: none unless similar texts are a large share of all
    large: dict[int, int] = {}
    if n > hot * shard:
        sizes = prints.select("fp").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot * shard)
        large = {r.key: -(-r.n // (hot * shard)) for r in sizes.collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, parts of the shard a and b, the part that these rows are, their bytes), many fingerprints in a row."""
        for raw in read(batches, together):
            out: list[tuple[int, int, int, int, bytes]] = []
            for key in heads(raw):
                by = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[by])) + 1
                for own in np.split(by, cuts):
                    k = int(key[own[0]])
                    if k not in large:
                        out.append((k, 0, 0, 0, raw[own].tobytes()))
                        continue
                    part = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) % large[k] for r in raw[own]])
                    for p in range(large[k]):
                        mine = raw[own[part == p]].tobytes()
                        out += [(k, min(p, q), max(p, q), p, mine) for q in range(large[k]) if mine]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "a", "b", "part", "rows"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, marks = None, [], []

        def whole() -> Iterator[pa.RecordBatch]:
            if now is not None:
                raw = np.concatenate(held)
                side = np.repeat(np.array(marks), [len(h) for h in held]) if now[1] != now[2] else None
                if out := _shard_pairs(raw, plan.orders[now[0] >> plan.head], plan, side):
                    yield out

        for batch in batches:
            for key, a, b, part, rows in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "part", "rows"))):
                if (key, a, b) != now:
                    yield from whole()
                    now, held, marks = (key, a, b), [], []
                held.append(np.frombuffer(rows, np.uint8).reshape(-1, 16))
                marks.append(part)
        yield from whole()

    packed = prints.select("fp").mapInArrow(spread, "key long, a int, b int, part int, rows binary")
    # a task for each of a few shards, not as many as their bytes alone would tell, since their work is more than linear; never more than about 256 MB for one
    tasks = max(1, min(trees << plan.head, max(int(spark.conf.get("spark.sql.shuffle.partitions")), trees, 16 * n * trees >> 28)))
    return packed.repartition(tasks, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(join, "a binary, b binary").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the connected component; large and small stars in turn until nothing changes.

    A node's least neighbour is an aggregate that is joined back, so that a hub with any number of neighbours is no single task.
    """
    u, v = F.col("u"), F.col("v")
    star = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u != v).distinct())
    state = None
    while True:
        both = star.union(star.select(v.alias("u"), u.alias("v")))
        large = both.where(v > u).join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select(v.alias("u"), F.least(u, "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        star = cut(small.where(u != v).distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return star.select(u.alias("node"), v.alias("root")).union(star.select(v.alias("node"), v.alias("root"))).distinct()


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, uid, fp) without the rows that have no fingerprint; uid numbers the rows."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "fp": [fingerprint(t) for t in batch.column("text").to_pylist()]}

    return map_arrow(docs, step, "doc_id long, row_key binary, fp binary").where("fp is not null").withColumn("uid", F.monotonically_increasing_id())


def ranked(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row_key, fp, keep_id, keep_fp, stays) of the rows in groups of two and more; `stays` is true for one of each. docs: doc_id, row_key, text."""
    mine = cut(prints(docs))
    unique = cut(mine.groupBy("fp").agg(F.count("*").alias("n")).repartition("fp"))
    roots = components(edges(unique, unique.count(), radius))
    several = unique.join(roots, unique.fp == roots.node, "left").where("root is not null or n > 1").select("fp", F.coalesce("root", "fp").alias("root"))
    grouped = mine.join(several, "fp")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "fp", "uid")).alias("keep"))
    return grouped.join(best, "root").select("doc_id", "row_key", "fp", F.col("keep.doc_id").alias("keep_id"), F.col("keep.fp").alias("keep_fp"), (F.col("uid") == F.col("keep.uid")).alias("stays"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row (doc_id, keep_id, distance) for each document that a group gives up for its document keep_id; distance: differing bits of the two."""
    found = ranked(id_text(docs, id_col, text_col).withColumn("row_key", F.lit(b"")), radius).where(~F.col("stays"))
    halves = [F.conv(F.hex(F.substring(c, at, 8)), 16, -10).cast("long") for at in (1, 9) for c in ("fp", "keep_fp")]
    return found.select("doc_id", "keep_id", (F.bit_count(halves[0].bitwiseXOR(halves[1])) + F.bit_count(halves[2].bitwiseXOR(halves[3]))).alias("distance"))


def _row_key(docs: DataFrame) -> Column:
    """A 128-bit hash of all columns."""

    def flat(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.MapType):
            return F.array_sort(F.map_entries(c))
        return c if isinstance(t, T.AtomicType | T.NullType) else F.to_json(F.struct(c.alias("x")))

    own = [x for f in docs.schema for x in (flat(F.col(f"`{f.name}`"), f.dataType), F.col(f"`{f.name}`").isNull())]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(salt), *own)), 16, "0") for salt in (1, 2)]))


def _listed(keys: DataFrame) -> tuple[int, DataFrame]:
    """The number of the keys, and the keys, marked for broadcast where 64 bytes for each stay within the session's threshold; the optimiser can't tell their size."""
    n, limit = keys.count(), keys.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return n, F.broadcast(keys) if 64 * n <= limit else keys


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without those rows that near_duplicates gives up; of a row that occurs several times, the same in all columns, one stays. Documents are shuffled once where the list of rows that go is too long to be broadcast, and once more only where that of repeated rows is, too."""
    key = _row_key(docs)
    found = ranked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("row_key")), radius)
    name = "__row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    special = cut(found.groupBy("row_key").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1").withColumnRenamed("row_key", name))
    keyed = docs.withColumn(name, key)
    _, out = _listed(special.select(name))
    repeated, again = _listed(special.where("stays").select(name))
    kept = keyed.join(out, name, "left_anti")
    if repeated:
        kept = kept.unionByName(keyed.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.select([F.col(f"`{c}`") for c in docs.columns])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
