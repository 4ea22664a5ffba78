"""Queries for listings, changes of names and contents, transactions, and the state of a dataset; a continuation of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from objectlake.functions import text as T
from objectlake.operators import fulltext, graph, integrity, lifecycle, namespace, versions
from objectlake.plans import sql as S
from objectlake.plans.predicates import And, Eq, Or, Semantic, SimilarTo, Tables, compile
from objectlake.plans.queries import _POSTINGS, _dataset, _stream, _texts, query
from objectlake.sources import files
from objectlake.sources import tables as src
from objectlake.sources.tables import object_id, table, union
from objectlake.streaming import access

# Listings


@query("select 'event/' || event_id as object_id, event_type as name, ts as modified from events order by ts desc, event_id limit 100")
def recent_objects(spark, d):
    """The 100 objects changed last."""
    own = table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(100)
    return own.select(object_id("event", "event_id").alias("object_id"), F.col("event_type").alias("name"), F.col("ts").alias("modified"))


@query(f"with {_POSTINGS}, hits as (select object_id, sum(freq)::bigint as score from postings where term in ('license', 'token') group by 1) select object_id, score, row_number() over (order by score desc, object_id)::int as rank from hits order by rank limit 100")
def text_ranked(spark, d):
    """The 100 best hits, of equally good ones by id."""
    return fulltext.ranked(fulltext.search_any_term(fulltext.postings_for(_texts(spark, d), "license token"), "license token"), 100)


@query(
    f"""with {S.TEXTS} select object_id, name, {S.CONTENT_TYPE} as content_type, created_ns, modified_ns, n_attributes from (
    select 'event/' || event_id as object_id, event_type as name, props as content, epoch_ns(ts) as created_ns, epoch_ns(ts) as modified_ns, 3::bigint as n_attributes from events
    union all select 'page/' || page_id, url, html, null, null, 2 from pages union all select 'document/' || doc_id, null, text, null, null, 4 from documents)"""
)
def object_summaries(spark, d):
    """Every object with its name, type, times and number of attributes."""
    events, pages, docs = (table(spark, d, n) for n in ("events", "pages", "documents"))
    ns, none = F.unix_micros(F.col("ts").cast("timestamp")) * 1000, F.lit(None)
    part = lambda t, oid, name, content, at: t.select(oid.alias("object_id"), name.cast("string").alias("name"), F.col(content).alias("content"), at.cast("long").alias("created_ns"), at.cast("long").alias("modified_ns"))
    rows = union([part(events, object_id("event", "event_id"), F.col("event_type"), "props", ns), part(pages, object_id("page", "page_id"), F.col("url"), "html", none), part(docs, object_id("document", "doc_id"), none, "text", none)])
    counted = src.attributes(spark, d).groupBy("object_id").agg(F.count("*").alias("n_attributes"))
    typed = rows.select("object_id", "name", T.content_type(F.col("content")).alias("content_type"), "created_ns", "modified_ns")
    return typed.join(counted, "object_id", "left").withColumn("n_attributes", F.coalesce("n_attributes", F.lit(0)))


def _searchable(spark, d):
    return Tables(src.objects(spark, d), src.document_attributes(spark, d), texts=_texts(spark, d))


@query(None)
def predicate_semantic(spark, d):
    """English documents among the 20 nearest to a text."""
    return compile(And((Semantic("released under the MIT license", 20), Eq("language", "en"))), _searchable(spark, d))


@query(None)
def predicate_similar(spark, d):
    """What is similar to a document, or to a text."""
    return compile(Or((SimilarTo("document/0", 5), Semantic("token and license", 5))), _searchable(spark, d))


# Edges and collections


@query(
    f"""with {S.TREE_EDGES}, last as (select src, max(pos) as last from tree group by 1), new as (select 'nation/' || s_nationkey as src, 'supplier/' || s_suppkey as dst, row_number() over (partition by s_nationkey order by 'supplier/' || s_suppkey) as nth from supplier)
    select src, pos, dst, kind, strength from tree union all select new.src, (coalesce(last, -1) + nth)::int, dst, 'related_to', 0.5 from new left join last using (src)"""
)
def add_bonds(spark, d):
    """Nations are given edges to their suppliers, after those that they have."""
    new = table(spark, d, "supplier").select(object_id("nation", "s_nationkey").alias("src"), object_id("supplier", "s_suppkey").alias("dst"), F.lit("related_to").alias("kind"), F.lit(0.5).alias("strength"), F.lit(None).cast("string").alias("label"))
    return graph.appended(src.tree_edges(spark, d), new).select("src", "pos", "dst", "kind", "strength")


@query("select row_number() over (order by source) as collection_id, source as name from (select distinct source from documents)")
def create_collections(spark, d):
    """Collections numbered from 1 in the order of their names."""
    names = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return graph.created(spark.createDataFrame([], "collection_id long, name string"), names)


# Names and contents


def _notes(spark, d):
    return table(spark, d, "nation").select(object_id("nation", "n_nationkey").alias("dir_id"), F.explode(F.array(F.lit("notes.txt"), F.lit(""), F.lit("a/b"), F.concat(F.lit("Customer#"), "n_nationkey"))).alias("name"))


_MADE = f"""{S.TREE_EDGES}, {S.NAMES}, held as (select src as dir_id, name from tree join names on object_id = dst),
  wanted as (select 'nation/' || n_nationkey as dir_id, unnest(['notes.txt', '', 'a/b', 'Customer#' || n_nationkey]) as name from nation),
  made as (select dir_id, name, sha256('file:' || dir_id || '/' || name) as object_id from wanted where name <> '' and not contains(name, '/') and (dir_id, name) not in (select dir_id, name from held))"""


@query(f"with {_MADE} select dir_id, name, object_id from made union all select src, name, object_id from tree join names on object_id = dst")
def make_files(spark, d):
    """New files in every nation; names that are empty, have a slash or are taken are refused."""
    edges, names = namespace.make(src.tree_edges(spark, d), src.tree_names(spark, d), _notes(spark, d))
    return namespace.entries(edges, names).select("dir_id", "name", "object_id")


_HEX = "hex(encode(text))"


@query(f"select doc_id, sha256(rpad(substr({_HEX}, 1, 10), 10, '0') || '58595A' || substr({_HEX}, 17)) as spliced, sha256(rpad(substr({_HEX}, 1, 400), 400, '0')) as truncated, substr({_HEX}, 9, 16) as part from documents")
def write_at(spark, d):
    """Bytes written at offset 5, the text cut or filled to 200 bytes, and 8 bytes read at offset 4."""
    text, digest = F.col("text"), lambda c: F.sha2(F.hex(c), 256)
    return table(spark, d, "documents").select("doc_id", digest(namespace.splice(text, 5, b"XYZ")).alias("spliced"), digest(namespace.truncated(text, 200)).alias("truncated"), F.hex(namespace.read_at(text, 4, 8)).alias("part"))


@query(f"with {S.TREE_EDGES} select src, dst from tree where dst not in (select 'order/' || o_orderkey from orders where o_orderstatus = 'F')")
def unlink_files(spark, d):
    """Orders of a status are removed with the edges that lead to them."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(object_id("order", "o_orderkey").alias("object_id"))
    return namespace.unlink(src.tree_edges(spark, d), gone).select("src", "dst")


@query("select 'customer/' || c_custkey as object_id from customer where c_custkey not in (select o_custkey from orders)")
def removable_dirs(spark, d):
    """Customers without orders: only an empty directory can be removed."""
    return namespace.removable(src.tree_edges(spark, d), table(spark, d, "customer").select(object_id("customer", "c_custkey").alias("object_id")))


@query(f"with {S.TREE_EDGES}, {S.NAMES} select case when dst = 'nation/1' then 'region/0' else src end as dir_id, case when dst = 'nation/1' then 'moved' else name end as name, dst as object_id from tree join names on object_id = dst")
def rename_entry(spark, d):
    """A nation gets another region and name; what is below it goes along."""
    edges, names = namespace.moved(src.tree_edges(spark, d), src.tree_names(spark, d), "nation/1", "region/0", "moved")
    return namespace.entries(edges, names).select("dir_id", "name", "object_id")


@query(
    """select 'document/' || doc_id as object_id, case when quality = 0 then 256 else 420 end as mode, case when quality = 0 then 10 else strlen(text) end::bigint as size, case when quality = 0 then 1 else ceil(strlen(text) / 512) end::bigint as blocks,
    case when quality = 0 then 1700000000000000000 else 0 end::bigint as mtime_ns from documents left join (select doc_id, min(quality) as quality from labels group by 1) using (doc_id)"""
)
def set_attributes(spark, d):
    """Permissions, size and time of documents of low quality are set, what isn't named stays."""
    content = table(spark, d, "documents").select(object_id("document", "doc_id").alias("object_id"), F.lit(0o644).alias("mode"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    bad = table(spark, d, "labels").where("quality = 0").select(object_id("document", "doc_id").alias("object_id")).distinct()
    return namespace.with_attributes(content, bad.select("object_id", F.lit(0o400).alias("mode"), F.lit(10).cast("long").alias("size"), F.lit(1_700_000_000_000_000_000).alias("mtime_ns")))


@query(
    """select p_partkey, case p_size % 6 when 0 then 'file' when 1 then 'dir' when 2 then 'symlink' when 3 then 'fifo' when 4 then 'block' else 'char' end as file_type,
    case p_size % 6 when 0 then '-' when 1 then 'd' when 2 then 'l' when 3 then 'p' when 4 then 'b' else 'c' end || list_reduce(list_transform(range(8, -1, -1), lambda i: case when (p_partkey % 512) & (1 << i) > 0 then ['x', 'w', 'r'][(i % 3) + 1] else '-' end), lambda a, b: a || b) as shown from part"""
)
def file_modes(spark, d):
    """Types of files, and permissions as they are listed."""
    kind = namespace.file_type(F.col("p_size") % 6)
    return table(spark, d, "part").select("p_partkey", kind.alias("file_type"), namespace.shown_mode(kind, F.col("p_partkey") % 512).alias("shown"))


# Transactions and logs


def _journal(spark, d):
    op = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "abort").otherwise("add")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), op.alias("op"), F.col("value").alias("payload"))


_JOURNAL = """j as (select event_id as seq, user_id as session, case event_type when 'signup' then 'begin' when 'purchase' then 'commit' when 'error' then 'abort' else 'add' end as op, value as payload from events),
  n as (select *, coalesce(count(*) filter (op in ('begin', 'commit', 'abort')) over (partition by session order by seq rows between unbounded preceding and 1 preceding), 0) as span from j),
  ends as (select session, span, max(case when op in ('begin', 'commit', 'abort') then op end) as ending from n group by 1, 2),
  opened as (select session, span + 1 as span from n where op = 'begin')"""


@query(f"with {_JOURNAL} select seq, session, payload from n join ends using (session, span) join opened using (session, span) where op = 'add' and ending = 'commit'")
def committed_entries(spark, d):
    """What a transaction of a session has added, if it was begun and committed: begun anew, aborted or left open, it counts for nothing."""
    return versions.committed(_journal(spark, d))


@query("select ((nth - 1) // 100)::bigint as batch, count(*) as n, min(seq) as first_seq, max(seq) as last_seq, count(*) >= 100 as flushed from (select event_id as seq, row_number() over (order by event_id) as nth from events) group by 1")
def auto_flush(spark, d):
    """A log that is flushed at every hundredth entry; the rest waits."""
    return lifecycle.flushes(table(spark, d, "events").select(F.col("event_id").alias("seq")), 100)


@query("select doc_id, text as payload from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def bulk_load(spark, d):
    """All blocks but those whose checksum is wrong, which are skipped."""
    toxic = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").join(toxic, "doc_id", "left")
    blocks = docs.select("doc_id", F.col("text").alias("payload"), (F.crc32(F.col("text").cast("binary")) + F.coalesce("toxic", F.lit(0))).alias("checksum"))
    return integrity.readable(blocks).select("doc_id", "payload")


@query(None)
def import_files(spark, d):
    """The files of a folder as objects."""
    found = files.read_files(spark, d, "*ion.parquet")
    size = found.where("name = 'size'").select("object_id", F.col("v_long").alias("size"))
    return found.where("name = 'name'").select("object_id", F.col("v_string").alias("name")).join(size, "object_id")


# The state of a dataset


@query("select * from (values (1::bigint, 'first', 1::bigint), (2, 'second', 2)) t(snapshot_id, label, version)")
def snapshot_list(spark, d):
    own, regions = _dataset(spark), table(spark, d, "region")
    for label in ("first", "second"):
        own.commit(region=regions)
        own.snapshot(label)
    return own.snapshots().select("snapshot_id", "label", "version")


@query("select 'region' as name, 2::bigint as n")
def unreferenced_tables(spark, d):
    """Folders of tables that neither the newest version nor a snapshot names."""
    own, regions = _dataset(spark), table(spark, d, "region")
    own.commit(region=regions, nation=table(spark, d, "nation"))
    own.commit(region=regions)
    own.snapshot("kept")
    own.commit(region=regions)
    own.commit(region=regions)
    rows = [(folder.split("/")[1],) for folder in own.unreferenced()]
    return spark.createDataFrame(rows, "name string").groupBy("name").agg(F.count("*").alias("n"))


@query("select * from (values ('snapshot', 1::bigint), ('version', 1)) t(kind, n)")
def snapshot_checks(spark, d):
    """A snapshot whose version is gone, and a version whose table is gone."""
    own, regions = _dataset(spark), table(spark, d, "region")
    own.commit(region=regions)
    own.snapshot("lost")
    own.commit(region=regions)
    own.commit(nation=table(spark, d, "nation"))
    own.forget(1)
    own.drop_folder(own.manifest(3)["tables"]["nation"])
    rows = [(p.split(" ")[0],) for p in own.problems()]
    return spark.createDataFrame(rows, "kind string").groupBy("kind").agg(F.count("*").alias("n"))


@query("select count(*) as n, 64 as dimensions, (count(*) * 64 * 8)::bigint as bytes from embeddings")
def stored_index(spark, d):
    """Vectors stored as a table and read again: how many, of which dimension, and their bytes."""
    own = _dataset(spark)
    own.commit(vectors=table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")))
    back = own.read("vectors")
    return back.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dimensions"), F.sum(F.size("vector").cast("long") * 8).alias("bytes"))


@query(
    """with e as (select event_type as object_id, case when event_id % 7 = 0 then 'queue' else 'access' end as kind, lag(case when event_id % 7 = 0 then 'queue' else 'access' end) over (partition by event_type order by ts, event_id) as before from events)
    select object_id, count(*) filter (kind = 'access' and before = 'queue') as hits, count(*) filter (kind = 'access' and before is distinct from 'queue') as misses from e group by 1"""
)
def stream_prefetch(spark, d):
    """Every seventh event puts its object into the queue, the others are accesses."""
    kind = F.when(F.col("seq") % 7 == 0, "queue").otherwise("access")
    return access.settle(access.prefetch(_stream(spark, d).withColumn("kind", kind)), keys=("object_id",))
