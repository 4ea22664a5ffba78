"""A query for each operator, over the driver's tables, with its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objectlake.functions import text as T
from objectlake.functions import vector
from objectlake.functions.codec import codec_stats, hashed_vector, text_embedding
from objectlake.operators import enrich, fulltext, graph, integrity, lifecycle, models, namespace, stats, vectors, versions
from objectlake.plans import sql as S
from objectlake.plans.predicates import And, Contains, Eq, Or, Related, Tables, compile, compile_wide
from objectlake.schema import kind_of, read_as, wide
from objectlake.session import importable, shared_dir
from objectlake.sources import tables as src
from objectlake.sources.dataset import Dataset
from objectlake.sources.tables import object_id, table, union
from objectlake.streaming import access

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run, sql
        return run

    return add


def _all() -> dict[str, tuple[Query, str | None]]:
    from objectlake.plans import changes  # noqa: F401 - its queries are added here

    return _QUERIES


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}


# Scans, sources and sinks


@query(f"with {S.ATTRIBUTES} select object_id, name, tag, v_string, v_long, v_double from attributes")
def full_scan(spark, d):
    return src.attributes(spark, d).select("object_id", "name", "tag", "v_string", "v_long", "v_double")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7")
def point_read(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select doc_id, exists(select 1 from labels l where l.doc_id = d.doc_id) as found from documents d")
def exists_batch(spark, d):
    labels = table(spark, d, "labels").select("doc_id").distinct().withColumn("__f", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("__f", F.lit(False)).alias("found"))


@query("select 'document/' || doc_id as object_id, lang as language, true as present from documents union all select 'page/' || page_id, null, false from pages")
def dim_read(spark, d):
    """One attribute of every object: absent is told apart from missing."""
    own = src.attributes(spark, d).where("name = 'language'").select("object_id", read_as("string").alias("language"), F.lit(True).alias("present"))
    objects = union([table(spark, d, "documents").select(object_id("document", "doc_id").alias("object_id")), table(spark, d, "pages").select(object_id("page", "page_id").alias("object_id"))])
    return objects.join(own, "object_id", "left").select("object_id", "language", F.coalesce("present", F.lit(False)).alias("present"))


@query("select c_custkey, case when o.n is null then c_acctbal else round(c_acctbal + o.total, 2) end as balance from customer left join (select o_custkey, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1) o on o_custkey = c_custkey")
def upsert(spark, d):
    """Customers with orders are written again with another balance."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    changes = customers.join(spent, "c_custkey").select("c_custkey", F.round(F.col("balance") + F.col("total"), 2).alias("balance"))
    return versions.upsert(customers, changes, ["c_custkey"])


@query("select 'document/' || d.doc_id as object_id, 'language' as name, case when l.toxic = 1 then upper(lang) else lang end as v_string from documents d left join labels l using (doc_id)")
def upsert_attribute(spark, d):
    own = src.document_attributes(spark, d).where("name = 'language'").select("object_id", "name", "v_string")
    bad = table(spark, d, "labels").where("toxic = 1").select(object_id("document", "doc_id").alias("object_id"))
    changes = own.join(bad, "object_id", "left_semi").withColumn("v_string", F.upper("v_string"))
    return versions.upsert(own, changes, ["object_id", "name"])


@query("select doc_id, lang, source from documents where doc_id not in (select doc_id from labels where quality = 0)")
def delete_objects(spark, d):
    return versions.delete(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels").where("quality = 0"), ["doc_id"])


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


@query(
    f"""with b as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents), t as (select {_crc_table()}::bigint[] as tab)
    select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::bigint) as crc from b, t"""
)
def checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


# Predicates and projections


@query("select 'document/' || doc_id as object_id, lang as language, n_chars, substr(text, 1, 20) as preview from documents where contains(text, 'the') and lang = 'en'")
def predicate_and(spark, d):
    rows = table(spark, d, "documents").select(object_id("document", "doc_id").alias("object_id"), F.col("lang").alias("language"), "n_chars", F.col("text").alias("content"))
    found = compile_wide(Contains("content", "the") & Eq("language", "en"), rows)
    return found.select("object_id", "language", "n_chars", F.substring("content", 1, 20).alias("preview"))


def _tables(spark, d):
    return Tables(src.objects(spark, d), src.attributes(spark, d), src.edges(spark, d))


@query("select 'document/' || doc_id as object_id from documents where lang = 'fr'")
def dim_equals(spark, d):
    return compile(Eq("language", "fr"), _tables(spark, d))


@query("select 'document/' || doc_id as object_id from documents where contains(text, 'License') union all select 'page/' || page_id from pages where contains(html, 'License')")
def dim_contains(spark, d):
    return compile(Contains("content", "License"), _tables(spark, d))


@query("select 'document/' || doc_id as object_id from documents where contains(text, 'the') and lang = 'en' and source = 'src3'")
def predicate_and_long(spark, d):
    return compile(And((Contains("content", "the"), Eq("language", "en"), Eq("source", "src3"))), _tables(spark, d))


@query("select 'document/' || doc_id as object_id from documents where lang = 'de' or n_chars = 12 or contains(text, 'MIT') union all select 'page/' || page_id from pages where contains(html, 'MIT')")
def predicate_or(spark, d):
    return compile(Or((Eq("language", "de"), Eq("n_chars", 12, "int64"), Contains("content", "MIT"))), _tables(spark, d))


@query("select 'nation/' || n_nationkey as object_id from nation where n_regionkey = 1 union all select 'customer/' || c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1")
def related_to(spark, d):
    return compile(Related("region/1", "contains", 1), _tables(spark, d))


@query("select 'event/' || event_id as object_id from events where event_type = 'purchase'")
def intent_lookup(spark, d):
    return compile(Eq("intent", "purchase"), _tables(spark, d))


@query("select doc_id, list_filter([case when quality >= 0.5 then 'quality' end, case when toxic * 0.5 >= 0.5 then 'toxic' end], lambda x: x is not null) as tags from labels")
def tag_confidence(spark, d):
    tags = F.array(*[F.struct(F.lit(n).alias("tag"), (F.col(n) * w).cast("double").alias("confidence")) for n, w in (("quality", 1.0), ("toxic", 0.5))])
    return table(spark, d, "labels").select("doc_id", F.transform(F.filter(tags, lambda x: x["confidence"] >= 0.5), lambda x: x["tag"]).alias("tags"))


@query("select 'page/' || page_id as object_id, substr(url, 1, 20) as name, substr(html, 1, 60) as preview from pages")
def preview(spark, d):
    return table(spark, d, "pages").select(object_id("page", "page_id").alias("object_id"), F.substring("url", 1, 20).alias("name"), F.substring("html", 1, 60).alias("preview"))


@query(f"with {S.EDGES}, {S.OBJECTS}, {S.NAMES} select object_id, name, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from objects left join names using (object_id) left join (select src as object_id, count(*) n_out from edges group by 1) using (object_id) left join (select dst as object_id, count(*) n_in from edges group by 1) using (object_id)")
def summary_projection(spark, d):
    counted = graph.degrees(src.objects(spark, d), src.edges(spark, d))
    return counted.join(src.tree_names(spark, d), "object_id", "left").select("object_id", "name", "n_out", "n_in")


@query(
    """select 'document/' || doc_id as object_id, name, v_string, v_double from documents left join labels using (doc_id), lateral (
    select * from (values ('content_type', 'text/plain', null::double), ('encoding', 'utf8', null), ('role', case when source = 'src0' then 'data' else 'unknown' end, null), ('language', lang, null), ('quality', null, coalesce(quality, 0)::double)) t(name, v_string, v_double))"""
)
def profile_attributes(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    rows = docs.select(object_id("document", "doc_id").alias("object_id"), F.lit("text/plain").alias("content_type"), F.lit(None).cast("string").alias("encoding"), F.when(F.col("source") == "src0", "data").alias("role"), F.col("lang").alias("language"), "quality")
    return enrich.profile(rows).select("object_id", "name", "v_string", "v_double")


@query("select p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(x)), ', ') as tags from part")
def tag_list(spark, d):
    return table(spark, d, "part").select("p_partkey", T.tag_list(F.replace("p_name", F.lit(" "), F.lit(" , "))).alias("tags"))


@query("select doc_id, sha256(text) as id, true as valid from documents")
def hex_ids(spark, d):
    raw = T.from_hex(F.sha2("text", 256))
    return table(spark, d, "documents").select("doc_id", T.to_hex(raw).alias("id"), raw.isNotNull().alias("valid"))


@query("select l_orderkey, l_linenumber, case l_linenumber when 1 then 'depends_on' when 2 then 'related_to' when 3 then 'version_of' when 4 then 'references' when 5 then 'composed_of' when 6 then 'derived_from' when 7 then 'computed_by' else 'custom' end as kind from lineitem")
def edge_kinds(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind_of(F.col("l_linenumber")).alias("kind"))


@query(f"with {S.ATTRIBUTES} select object_id, name, case when tag = 'int64' then v_long end as as_long, case when tag = 'string' then strlen(v_string) end as as_string from attributes")
def typed_values(spark, d):
    return src.attributes(spark, d).select("object_id", "name", read_as("int64").alias("as_long"), F.octet_length(read_as("string")).cast("long").alias("as_string"))


@query("select 'document/' || doc_id as object_id, text as content, lang as language, n_chars from documents")
def wide_view(spark, d):
    return wide(src.document_attributes(spark, d), {"content": "string", "language": "string", "n_chars": "int64"})


# Graph


@query(f"with {S.EDGES} select src, dst, kind, strength from edges where src like 'customer/%'")
def bonds_out(spark, d):
    customers = table(spark, d, "customer").select(object_id("customer", "c_custkey").alias("object_id"))
    return graph.outgoing(src.edges(spark, d), customers).select("src", "dst", "kind", "strength")


@query(f"with {S.EDGES} select src, dst, pos, strength from edges where kind = 'depends_on' and dst like 'part/%'")
def bonds_in(spark, d):
    parts = table(spark, d, "part").select(object_id("part", "p_partkey").alias("object_id"))
    return graph.incoming(src.edges(spark, d), parts, "depends_on").select("src", "dst", "pos", "strength")


@query(f"with {S.EDGES} select src, dst, pos from edges where kind = 'references'")
def bonds_by_kind(spark, d):
    return src.edges(spark, d).where("kind = 'references'").select("src", "dst", "pos")


@query(f"with {S.EDGES}, {S.OBJECTS} select object_id, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from objects left join (select src as object_id, count(*) n_out from edges group by 1) using (object_id) left join (select dst as object_id, count(*) n_in from edges group by 1) using (object_id)")
def bond_degree(spark, d):
    return graph.degrees(src.objects(spark, d), src.edges(spark, d))


@query(
    f"""with {S.TREE_EDGES} select 'region/' || r_regionkey as start, dst as object_id, 1 as hops from region join tree on src = 'region/' || r_regionkey
    union all select a.src, b.dst, 2 from tree a join tree b on a.dst = b.src where a.src like 'region/%'
    union all select a.src, c.dst, 3 from tree a join tree b on a.dst = b.src join tree c on b.dst = c.src where a.src like 'region/%'"""
)
def traverse_depth(spark, d):
    regions = table(spark, d, "region").select(object_id("region", "r_regionkey").alias("object_id"))
    return graph.traverse(src.tree_edges(spark, d), src.objects(spark, d), regions, "contains", 2)


def _broken(spark, d):
    """Documents that reference their labels, and labelled documents as objects."""
    docs = table(spark, d, "documents").select(object_id("document", "doc_id").alias("src"), F.lit(0).alias("pos"), object_id("label", "doc_id").alias("dst"), F.lit("references").alias("kind"), F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("label"))
    return docs, table(spark, d, "labels").select(object_id("label", "doc_id").alias("object_id"))


@query("select 'document/' || doc_id as src, 'label/' || doc_id as dst from documents where doc_id not in (select doc_id from labels)")
def dangling(spark, d):
    return graph.dangling(*_broken(spark, d)).select("src", "dst")


@query("select 'document/' || doc_id as src, 'label/' || doc_id as dst from documents where doc_id in (select doc_id from labels)")
def repair(spark, d):
    return graph.repaired(*_broken(spark, d)).select("src", "dst")


@query(f"with {S.TREE_EDGES}, {S.OBJECTS} select object_id from objects where object_id not in (select dst from tree)")
def orphans(spark, d):
    """Regions, parts and suppliers: with several tops none is the root."""
    return graph.orphans(src.objects(spark, d), src.tree_edges(spark, d))


@query(f"with {S.NAMES}, {S.OBJECTS} select object_id, coalesce(name, substr(object_id, 1, 8)) as name, 'file' as node_group from objects left join names using (object_id) union all select 'document/' || doc_id, substr('document/' || doc_id, 1, 8), 'text' from documents")
def graph_nodes(spark, d):
    named = src.tree_names(spark, d)
    from objectlake.schema import attribute

    docs = table(spark, d, "documents")
    attributes = attribute(named, F.col("object_id"), "name", "string", F.col("name")).unionByName(attribute(docs, object_id("document", "doc_id"), "content_type", "string", F.lit("text/plain")))
    return graph.nodes(src.objects(spark, d).unionByName(docs.select(object_id("document", "doc_id").alias("object_id"))), attributes)


@query(f"with {S.EDGES} select src as source, dst as target, kind, strength from edges")
def graph_links(spark, d):
    return src.edges(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "strength")


@query(f"with {S.EDGES} select src, dst, strength, row_number() over (partition by src order by strength desc, pos, dst, kind)::int as rank from edges where kind = 'depends_on' and strength > 0.5")
def strong_neighbors(spark, d):
    return graph.strong_neighbours(src.edges(spark, d).where("kind = 'depends_on'")).select("src", "dst", "strength", "rank")


def _members(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("collection_id"), object_id("document", "doc_id").alias("object_id"))


@query("select source as collection_id, count(*) as members from documents where doc_id not in (select doc_id from labels where quality = 0) group by 1")
def collections(spark, d):
    """Members are added twice, bad ones removed, the rest counted."""
    members = graph.add_members(_members(spark, d), _members(spark, d))
    gone = table(spark, d, "labels").where("quality = 0").select(object_id("document", "doc_id").alias("object_id")).join(members, "object_id")
    return graph.remove_members(members, gone.select("collection_id", "object_id")).groupBy("collection_id").agg(F.count("*").alias("members"))


@query("select distinct source as collection_id, unnest(['content', 'language', 'source', 'n_chars']) as name from documents")
def collection_signature(spark, d):
    return graph.signature(_members(spark, d), src.document_attributes(spark, d))


@query(f"with {S.EDGES}, {S.OBJECTS} select o.object_id, count(e.src) as n_edges, list(dst order by pos, dst, kind) filter (dst is not null) as targets from objects o left join edges e on e.src = o.object_id group by 1")
def assemble(spark, d):
    objects = src.objects(spark, d)
    whole = graph.assemble(objects, src.document_attributes(spark, d), src.edges(spark, d))
    return whole.select("object_id", F.coalesce(F.array_size("edges"), F.lit(0)).cast("long").alias("n_edges"), F.transform("edges", lambda e: e["dst"]).alias("targets"))


# Aggregations


@query(f"with {S.ATTRIBUTES} select name, count(*) as n from attributes group by 1 order by n desc, name limit 20")
def attr_histogram(spark, d):
    return stats.histogram(src.attributes(spark, d), "name", 20)


@query(f"with {S.EDGES} select kind, count(*) as n from edges group by 1")
def bond_histogram(spark, d):
    return stats.histogram(src.edges(spark, d), "kind")


@query(f"with {S.ATTRIBUTES} select (select count(*) from documents) + (select count(*) from pages) + (select count(*) from events) as n_objects, (select count(distinct source) from documents) as n_collections, count(*) as n_attributes, sum(coalesce(strlen(v_string), 8)) as n_bytes from attributes")
def volume_stats(spark, d):
    a = src.attributes(spark, d).agg(F.count("*").alias("n_attributes"), F.sum(F.coalesce(F.octet_length("v_string"), F.lit(8))).alias("n_bytes"))
    n = lambda t: table(spark, d, t).agg(F.count("*").alias(f"n_{t}"))
    c = table(spark, d, "documents").agg(F.count_distinct("source").alias("n_collections"))
    both = n("documents").crossJoin(n("pages")).crossJoin(n("events")).crossJoin(c).crossJoin(a)
    return both.select(F.expr("n_documents + n_pages + n_events").alias("n_objects"), "n_collections", "n_attributes", "n_bytes")


_DEDUP = "(select sha256(text) as hash, count(*) as refs, max(strlen(text)) as size from documents group by 1)"


@query(f"select count(*) as unique_values, sum(refs) as refs, sum(refs - 1) as hits, sum(size * (refs - 1)) as bytes_saved, sum(size) as bytes_stored, sum(size * refs) as bytes_referenced, round(sum(refs - 1) / sum(refs), 6) as ratio from {_DEDUP}")
def dedup_stats(spark, d):
    return stats.dedup_stats(table(spark, d, "documents"), "text")


@query("select hash, count(*) as refs from (select sha256(text) as hash, doc_id from documents) where doc_id not in (select doc_id from labels where quality = 0) group by 1")
def dedup_live(spark, d):
    """Every document refers to its text; bad ones release it."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    gone = docs.join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi")
    return stats.live_references(docs.select("hash", F.lit(1).alias("delta")).unionByName(gone.select("hash", F.lit(-1).alias("delta"))))


@query(f"with {S.ATTRIBUTES} select sha256(name || tag || coalesce(v_string, v_long::varchar, '')) as block, count(*) as refs from attributes where tag <> 'float64' group by 1")
def dedup_attributes(spark, d):
    """Equal values of equal names share a block; all have the same provenance here."""
    own = src.attributes(spark, d).where("tag <> 'float64'")
    return own.groupBy(F.sha2(F.concat("name", "tag", F.coalesce("v_string", F.col("v_long").cast("string"), F.lit(""))), 256).alias("block")).agg(F.count("*").alias("refs"))


@query("select 'document/' || doc_id as object_id, sha256('content' || text || 'language' || lang || 'n_chars' || n_chars || 'source' || source) as hash from documents")
def canonical_hash(spark, d):
    return stats.canonical_hash(src.document_attributes(spark, d))


@query(f"with {S.LOG} select object_id, arg_max(ts, seq) as last_ts, count(*) as total, count(case when access_type = 'read' then 1 end) as reads, count(case when access_type = 'write' then 1 end) as writes from log group by 1")
def access_stats(spark, d):
    return stats.access_stats(src.access_log(spark, d))


def _queue(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts")
    ranked = table(spark, d, "events").select("event_type", "ts", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("event_type")).alias("n"))
    return ranked.where(F.col("r") == F.ceil(F.col("n") / 2)).select(F.col("event_type").alias("object_id"), F.col("ts").alias("queued_ts"))


@query("with events2 as (select event_type, ts, row_number() over (partition by event_type order by ts) r, count(*) over (partition by event_type) n from events), q as (select event_type, ts as queued from events2 where r = ceil(n / 2)) select count(distinct e.event_type) filter (e.ts >= q.queued) as hits, count(*) - count(distinct e.event_type) filter (e.ts >= q.queued) as misses, round(count(distinct e.event_type) filter (e.ts >= q.queued) / count(*), 6) as hit_rate from events e left join q using (event_type)")
def prefetch_hits(spark, d):
    return lifecycle.prefetch_hits(src.access_log(spark, d), _queue(spark, d))


@query("select user_id, round(count(case when event_type = 'purchase' then 1 end) / count(*), 6) as hit_rate from events group by 1")
def hit_rate(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("hit_rate"))


@query(f"with {S.ATTRIBUTES}, s as (select name, strlen(name) as l, coalesce(strlen(v_string), 8) + 55 as e from attributes) select name, count(*) as n, sum(case when e + 18 + l <= 4096 then 1 else 1 + ceil((e - (4078 - l)) / 4080) end)::bigint as blocks from s group by 1")
def footprint(spark, d):
    size = stats.blocks(F.col("name"), F.coalesce(F.octet_length("v_string"), F.lit(8)))
    return src.attributes(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.sum(size).alias("blocks"))


@query("select l_returnflag, l_linestatus, sum(l_quantity)::double as qty, count(distinct l_suppkey) as suppliers, grouping(l_returnflag, l_linestatus)::bigint as level from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_stats(spark, d):
    """Beyond the model: all groupings at once, with distinct counts."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count_distinct("l_suppkey").alias("suppliers"), F.grouping_id("l_returnflag", "l_linestatus").alias("level"))


# Full text


def _texts(spark, d):
    return table(spark, d, "documents").select(object_id("document", "doc_id").alias("object_id"), "text")


def _postings(spark, d):
    return fulltext.postings(_texts(spark, d))


_POSTINGS = f"postings as (select term, 'document/' || doc_id as object_id, count(*) as freq from (select doc_id, unnest({S.TOKENS.format('text')}) as term from documents) group by 1, 2)"


@query(f"select doc_id, {S.TOKENS.format('text')} as tokens from documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query(f"with {_POSTINGS} select term, object_id, 'content' as dimension, freq from postings")
def postings(spark, d):
    return _postings(spark, d)


@query(f"with {_POSTINGS} select term, object_id, freq from postings where object_id not in (select 'document/' || doc_id from labels)")
def postings_remove(spark, d):
    gone = table(spark, d, "labels").select(object_id("document", "doc_id").alias("object_id"))
    return fulltext.without(_postings(spark, d), gone).select("term", "object_id", "freq")


@query(f"with {_POSTINGS} select object_id, sum(freq) / 2 as score from postings where term in ('license', 'the') group by 1 having count(*) = 2")
def text_and(spark, d):
    return fulltext.search_all_terms(fulltext.postings_for(_texts(spark, d), "the license", True), "the license")


@query(f"with {_POSTINGS} select object_id, sum(freq)::bigint as score from postings where term in ('license', 'token') group by 1")
def text_any(spark, d):
    return fulltext.search_any_term(fulltext.postings_for(_texts(spark, d), "License, token"), "License, token")


@query(f"with {_POSTINGS} select count(distinct term) as n_terms from postings")
def vocab(spark, d):
    return fulltext.vocabulary_size(_postings(spark, d))


@query(f"with {_POSTINGS} select count(distinct term) as n_terms, count(distinct object_id) as n_objects, count(*) as n_postings, sum(freq)::bigint as n_tokens from postings")
def totals(spark, d):
    return _postings(spark, d).agg(F.count_distinct("term").alias("n_terms"), F.count_distinct("object_id").alias("n_objects"), F.count("*").alias("n_postings"), F.sum("freq").alias("n_tokens"))


# Enrichment


def _contents(spark, d):
    t = lambda n, oid, c: table(spark, d, n).select(oid.alias("object_id"), F.col(c).alias("content"))
    turn = F.concat(F.lit("turn/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return union([t("documents", object_id("document", "doc_id"), "text"), t("pages", object_id("page", "page_id"), "html"), t("pages", object_id("url", "page_id"), "url"), t("events", object_id("event", "event_id"), "props"), t("conversations", turn, "text")])


@query(f"with {S.TEXTS} select object_id, {S.CONTENT_TYPE} as content_type from texts")
def content_type(spark, d):
    return _contents(spark, d).select("object_id", T.content_type(F.col("content")).alias("content_type"))


_EXTRACTED = f"""typed as (select *, {S.CONTENT_TYPE} as content_type from texts),
extracted as (select *, case when content_type in ('application/json', 'text/markdown', 'text/plain', 'text/xml', 'text/yaml') then content
  when regexp_full_match(content, '(?s)[\\x21-\\x7E \\t\\n\\f\\r]{{0,256}}') or (regexp_matches(content, '^[\\x21-\\x7E \\t\\n\\f\\r]{{256}}')) then substr(content, 1, 256) end as extracted from typed)"""


@query(f"with {S.TEXTS}, {_EXTRACTED} select object_id, extracted from extracted")
def extract_text(spark, d):
    return _contents(spark, d).select("object_id", T.extract_text(F.col("content"), T.content_type(F.col("content"))).alias("extracted"))


@query(f"with {S.TEXTS} select object_id, list_sort(list_distinct(list_concat({S.TYPE_TAGS.format(S.CONTENT_TYPE)}, {S.keyword_tags('content')}))) as tags from texts")
def keyword_tags(spark, d):
    return _contents(spark, d).select("object_id", T.rule_tags(F.col("content"), T.content_type(F.col("content"))).alias("tags"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOP = f"""(select object_id, list(term order by freq desc, term) as words from (
   select object_id, term, count(*) as freq, row_number() over (partition by object_id order by count(*) desc, term) as r
   from (select object_id, unnest({S.TOKENS.format('TEXT')}) as term from ROWS) where strlen(term) > 3 and term not in ({_STOPS}) group by 1, 2) where r <= 3 group by 1)"""


@query(f"with texts as (select 'document/' || doc_id as object_id, text as content from documents) select object_id, coalesce(words, []) as words from texts left join {_TOP.replace('TEXT', 'content').replace('ROWS', 'texts')} using (object_id)")
def frequent_words(spark, d):
    return _texts(spark, d).select("object_id", T.frequent_words(F.col("text")).alias("words"))


@query(f"select doc_id, {S.LANGUAGE.format('text')} as language from documents")
def language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query("select doc_id, round(least(1.0, 0.5 + 0.1 + 0.1 + case when n_chars > 100 then 0.1 else 0 end + 0.1 * least(turns / 5.0, 1.0) + case when labelled then 0.1 else 0 end), 6)::double as quality from (select doc_id, n_chars, doc_id % 7 as turns, doc_id in (select doc_id from labels) as labelled from documents)")
def quality(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    return docs.select("doc_id", T.quality(F.col("source").isNotNull(), F.col("text").isNotNull(), F.col("n_chars") > 100, F.pmod("doc_id", F.lit(7)), F.coalesce("labelled", F.lit(False))).alias("quality"))


@query(f"select doc_id, {S.summary('text')} as summary from documents")
def summary(spark, d):
    return table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("select page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/]*/(.*)$', 1), ''), url) as text from pages")
def search_text(spark, d):
    """The first of extracted text, name and content that there is."""
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]*/(.*)$", 1), F.lit("")), "url", "html").alias("text"))


@query("select page_id, '/' || array_to_string(parts[1:-2], '/') as parent, parts[-1] as name from (select page_id, list_filter(string_split(url, '/'), lambda p: p <> '') as parts from pages)")
def split_path(spark, d):
    return table(spark, d, "pages").select("page_id", T.parent_of(F.col("url")).alias("parent"), T.base_of(F.col("url")).alias("name"))


def _enrichable(spark, d):
    none = F.lit(None).cast("string")
    return _contents(spark, d).select("object_id", none.alias("name"), "content", none.alias("content_type"), F.lit(0).alias("n_edges"))


@query(
    f"""with {S.TEXTS}, {_EXTRACTED}, tops as {_TOP.replace('TEXT', 'extracted').replace('ROWS', 'extracted')},
    tagged as (select *, case when extracted is null then [] else list_sort(list_distinct(list_concat(list_concat({S.TYPE_TAGS.format('content_type')}, {S.keyword_tags('extracted')}), coalesce(words, [])))) end as tags from extracted left join tops using (object_id)),
    found as (select object_id, '_detected_type' as name, content_type as v_string, null::double as v_double from tagged
      union all select object_id, '_extracted_text', extracted, null from tagged
      union all select object_id, '_auto_tags', case when len(tags) > 0 then array_to_string(tags, ', ') end, null from tagged
      union all select object_id, '_language', {S.LANGUAGE.format('extracted')}, null from tagged
      union all select object_id, '_quality', null, round(least(1.0, 0.6 + case when extracted is not null then 0.1 else 0 end + 0.1 * least(len(tags) / 5.0, 1.0)), 6)::double from tagged
      union all select object_id, '_summary', case when extracted is not null then {S.summary('extracted')} end, null from tagged)
    select * from found where v_string is not null or v_double is not null"""
)
def enrich_objects(spark, d):
    return enrich.enrich(_enrichable(spark, d)).select("object_id", "name", "v_string", "v_double")


@query(None)
def codec_choice(spark, d):
    got = table(spark, d, "documents").select("doc_id", codec_stats(F.col("text").cast("binary")).alias("s"))
    return got.select("doc_id", "s.algo", "s.original", "s.compressed", "s.ratio")


@query(None)
def codec_summary(spark, d):
    got = _contents(spark, d).select(codec_stats(F.col("content").cast("binary")).alias("s")).select("s.*")
    return got.groupBy("algo").agg(F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"))


# Vectors


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("object_id"), F.col("embedding").alias("vector"))


_V = "v as (select vec_id::varchar as object_id, embedding::double[] as vector from embeddings)"


#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 50


def _asking(spark, d):
    return _vectors(spark, d).where(F.col("object_id").cast("long") % EVERY == 0)


def _search_sql(function: str, order: str, k: int = 10, more: str = "", columns: str = "query_id, object_id, round(score, 6) as score, cast(rank as integer) as rank") -> str:
    return f"""with {_V}, s as (select q.object_id as query_id, v.object_id, {function}(v.vector, q.vector) as score from v, v q where q.object_id::bigint % {EVERY} = 0)
    select {columns} from (select *, row_number() over (partition by query_id order by score {order}, object_id) as rank from s) where rank <= {k}{more}"""


@query(_search_sql("list_cosine_similarity", "desc"))
def knn_cosine(spark, d):
    return vectors.search_blocks(_vectors(spark, d), _asking(spark, d), 10).select("query_id", "object_id", F.round("score", 6).alias("score"), "rank")


@query(_search_sql("list_distance", "asc"))
def knn_euclidean(spark, d):
    return vectors.search_blocks(_vectors(spark, d), _asking(spark, d), 10, "euclidean").select("query_id", "object_id", F.round("score", 6).alias("score"), "rank")


@query(_search_sql("list_cosine_similarity", "desc", 5, " and query_id <> object_id", "query_id, object_id, round(score, 6) as score"))
def similar_to(spark, d):
    """The 5 nearest of each query, of which itself is then left out."""
    return vectors.search_blocks(_vectors(spark, d), _asking(spark, d), 5).where("query_id <> object_id").select("query_id", "object_id", F.round("score", 6).alias("score"))


@query(_search_sql("list_cosine_similarity", "desc"))
def knn_lsh(spark, d):
    return vectors.search_lsh(_vectors(spark, d), _asking(spark, d), 10).select("query_id", "object_id", F.round("score", 6).alias("score"), "rank")


@query("select vec_id, list_transform(embedding::double[], lambda x: greatest(0.0, least(255.0, trunc((x + 1) * 127.5)))::int) as q from embeddings")
def quantize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vector.quantize(F.col("embedding")).alias("q"))


@query("select vec_id, round(list_max(list_transform(embedding::double[], lambda x: abs(greatest(0.0, least(255.0, trunc((x + 1) * 127.5))) / 127.5 - 1 - x))), 6) as error from embeddings")
def dequantize_error(spark, d):
    v = F.col("embedding").cast("array<double>")
    errors = F.zip_with(vector.dequantize(vector.quantize(v)), v, lambda a, b: F.abs(a - b))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(errors), 6).alias("error"))


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings where len(embedding) = 64")
def vector_insert(spark, d):
    """Vectors of the index's dimension, each id once: of several the least."""
    own = table(spark, d, "embeddings").where(F.size("embedding") == 64).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return own.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query("select vec_id, label from embeddings where vec_id not in (select doc_id from labels where quality = 0)")
def vector_remove(spark, d):
    gone = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return versions.delete(table(spark, d, "embeddings").select("vec_id", "label"), gone, ["vec_id"])


@query(None)
def embed_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(text_embedding("text"), lambda x: F.round(x, 6)).alias("vector"))


@query(None)
def hash_vector(spark, d):
    return table(spark, d, "part").select("p_partkey", hashed_vector("p_name").alias("vector"))


@query(None)
def semantic_search(spark, d):
    texts = table(spark, d, "documents").select(object_id("document", "doc_id").alias("object_id"), "text")
    return vectors.semantic_search(texts, "released under the MIT license", 10).select("object_id", F.round("score", 6).alias("score"))


# Lifecycle


@query("select 'user/' || user_id as object_id, count(*) as total, case when count(*) <= 5 then 'hot' when count(*) <= 50 then 'warm' else 'cold' end as tier from events group by 1 union all select 'customer/' || c_custkey, 0, 'cold' from customer")
def tiers(spark, d):
    log = src.access_log(spark, d).withColumn("object_id", F.concat(F.lit("user/"), F.col("session").cast("string")))
    objects = log.select("object_id").distinct().unionByName(table(spark, d, "customer").select(object_id("customer", "c_custkey").alias("object_id")))
    return lifecycle.tiers(objects, log)


@query(
    """with a as (select user_id::varchar as object_id, greatest(0, floor(epoch(timestamp '2024-02-10')) - floor(epoch(arg_max(ts, event_id))))::bigint as age_s from events group by 1)
    select object_id, age_s, case when age_s > 1000000 then 'archive' when age_s > 900000 then 'compress' end as action from a where age_s > 900000"""
)
def retention(spark, d):
    log = src.access_log(spark, d).withColumn("object_id", F.col("session").cast("string"))
    policies = spark.createDataFrame([(1, True, 1_000_000, "archive"), (2, False, 0, "delete"), (3, True, 900_000, "compress"), (4, True, 950_000, "notify")], "policy_no int, enabled boolean, max_age_s long, action string")
    return lifecycle.retention(log, policies, "2024-02-10 00:00:00")


_PATTERNS = """x as (select row_number() over (order by ts, event_id) as nth, event_type as a, lead(event_type, 1) over (order by ts, event_id) as b, lead(event_type, 2) over (order by ts, event_id) as next from events),
y as (select *, count(*) over (partition by a, b) as n, row_number() over (partition by a, b order by nth) as r from x where b is not null),
found as (select a, b, next, sum(n - r)::bigint as freq, min(nth) as first_nth from y where next is not null group by 1, 2, 3 having sum(n - r) > 0)"""


@query(f"with {_PATTERNS} select a, b, next, freq, first_nth from found")
def access_patterns(spark, d):
    return lifecycle.patterns(src.access_log(spark, d))


@query(
    """with x as (select user_id, row_number() over w as nth, event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as next from events window w as (partition by user_id order by ts, event_id)),
    y as (select *, count(*) over (partition by user_id, a, b) as n, row_number() over (partition by user_id, a, b order by nth) as r from x where b is not null)
    select user_id as session, a, b, next, sum(n - r)::bigint as freq, min(nth) as first_nth from y where next is not null group by 1, 2, 3, 4 having sum(n - r) > 0"""
)
def access_patterns_by_user(spark, d):
    return lifecycle.patterns(src.access_log(spark, d), "session").withColumn("first_nth", F.col("first_nth").cast("long"))


@query(f"with {_PATTERNS}, last as (select a, b from x where b is not null order by nth desc limit 1) select next, freq, row_number() over (order by first_nth)::int as rank from found join last using (a, b) where freq > 1")
def predict_next(spark, d):
    return lifecycle.predict(src.access_log(spark, d))


@query("select event_id as seq, user_id as session from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 20")
def log_tail(spark, d):
    return lifecycle.log_tail(src.access_log(spark, d), "session", 20).select("seq", "session")


# Streams: the same tables taken as they come; all that is there is processed, and the last state compared


def _stream(spark, d):
    # a pattern, since a stream's source can't be the path of a single file
    events = access.read_log(spark, f"{d}/event?.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("object_id"), F.col("user_id").alias("session"), "ts", F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("access_type"))


@query(f"with {S.LOG} select object_id, arg_max(ts, seq) as last_ts, count(*) as total, count(*) filter (where access_type = 'read') as reads, count(*) filter (where access_type = 'write') as writes from log group by 1")
def stream_access_stats(spark, d):
    return access.settle(access.counters(_stream(spark, d)), keys=("object_id",))


@query("select user_id::varchar as object_id, count(*) as total, case when count(*) <= 5 then 'hot' when count(*) <= 50 then 'warm' else 'cold' end as tier from events group by 1")
def stream_tiers(spark, d):
    return access.settle(access.tiers(_stream(spark, d).withColumn("object_id", F.col("session").cast("string"))), keys=("object_id",))


@query("select time_bucket(interval 1 day, ts) as day, event_type as object_id, count(*) as n from events group by 1, 2")
def stream_windows(spark, d):
    found = access.settle(access.windows(_stream(spark, d)), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("day"), "object_id", "n")


@query(
    """with g as (select *, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts) as nth from g)
    select user_id as session, min(ts) as first_ts, max(ts) + interval 6 hour as end_ts, count(*) as n from s group by user_id, nth"""
)
def stream_visits(spark, d):
    found = access.settle(access.visits(_stream(spark, d), "session", "6 hours"), "complete")
    return found.select("session", F.col("start").cast("timestamp_ntz").alias("first_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")


@query(
    """with x as (select user_id, row_number() over w as nth, event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as next from events window w as (partition by user_id order by ts, event_id)),
    y as (select *, count(*) over (partition by user_id, a, b) as n, row_number() over (partition by user_id, a, b order by nth) as r from x where b is not null)
    select user_id as session, a, b, next, sum(n - r)::bigint as freq from y where next is not null group by 1, 2, 3, 4 having sum(n - r) > 0"""
)
def stream_patterns(spark, d):
    return access.settle(access.patterns(_stream(spark, d), "session"), keys=("session", "a", "b", "next"))


# Versions


def _dataset(spark):
    return Dataset(spark, f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}")


@query("select doc_id, lang, text from documents")
def snapshot_restore(spark, d):
    """The documents after they were stored, kept, replaced and restored."""
    docs, own = table(spark, d, "documents").select("doc_id", "lang", "text"), _dataset(spark)
    own.commit(documents=docs)
    kept = own.snapshot("before")
    own.commit(documents=docs.where("lang = 'en'"))
    own.restore(kept)
    own.compact()
    return own.read("documents")


@query("select doc_id as object_id, case when quality is null then lang else lang || quality end as lang from documents d left join (select doc_id as i, min(quality) as quality from labels group by 1) l on i = doc_id where coalesce(quality, 1) = 1")
def change_log(spark, d):
    """The documents after two batches of logged changes: labelled ones are written anew, those of low quality deleted."""
    docs, own = table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), "lang"), _dataset(spark)
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("object_id")).agg(F.min("quality").alias("quality"))
    own.commit(documents=docs)
    changed = docs.join(labels.where("quality is not null"), "object_id")
    own.log(changed.select((F.col("object_id") + 1).alias("seq"), F.lit("write").alias("op"), "object_id", F.concat("lang", F.col("quality").cast("string")).alias("lang")))
    own.checkpoint("documents")
    top = changed.agg(F.max("object_id")).first()[0] or 0
    own.log(changed.where("quality = 0").select((F.col("object_id") + top + 2).alias("seq"), F.lit("delete").alias("op"), "object_id", F.lit(None).cast("string").alias("lang")))
    own.checkpoint("documents")
    return own.read("documents")


def _versions(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("object_id"), F.col("turn").alias("version"), F.col("text").alias("content"))


@query("select object_id, version from (select conv_id as object_id, turn as version, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 3")
def versions_keep(spark, d):
    return versions.keep_newest(_versions(spark, d), 3).select("object_id", "version")


@query("select conv_id as object_id, max(turn) as version, arg_max(text, turn) as content from conversations group by 1")
def version_latest(spark, d):
    return versions.latest(_versions(spark, d))


@query("select conv_id as object_id, turn as version from conversations where turn >= 2")
def version_prune(spark, d):
    return versions.pruned(_versions(spark, d), 2).select("object_id", "version")


@query("select conv_id as object_id, turn as version, row_number() over (partition by conv_id order by turn)::int as nth from conversations")
def version_chain(spark, d):
    return _versions(spark, d).select("object_id", "version", F.row_number().over(Window.partitionBy("object_id").orderBy("version")).alias("nth"))


@query("select a.conv_id as object_id, sha256(a.text) <> sha256(b.text) as changed from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = 0 and b.turn = 1")
def version_diff(spark, d):
    return versions.diff(_versions(spark, d), 0, 1)


@query("select conv_id as object_id, max(turn) as version, arg_max(text, turn) as content from conversations where turn <= 2 group by 1")
def as_of(spark, d):
    return versions.as_of(_versions(spark, d), 2)


@query("select user_id as object_id, max(event_id) as seq, arg_max(value, event_id) as value from events where event_id > 500 group by 1 having arg_max(event_type, event_id) <> 'purchase'")
def replay(spark, d):
    """Purchases delete, other events write; all up to 500 is in a checkpoint."""
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "delete").otherwise("write").alias("op"), F.col("user_id").alias("object_id"), "value")
    return versions.replay(log, 500)


# Namespace


_PATHS = "paths as (select '/' || r_name as path, 'region/' || r_regionkey as object_id, 0 as depth from region union all select '/' || r_name || '/' || n_name, 'nation/' || n_nationkey, 1 from region join nation on n_regionkey = r_regionkey union all select '/' || r_name || '/' || n_name || '/' || c_name, 'customer/' || c_custkey, 2 from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey union all select '/' || r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey, 'order/' || o_orderkey, 3 from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey)"


def _paths(spark, d):
    regions = table(spark, d, "region").select(object_id("region", "r_regionkey").alias("object_id"))
    return namespace.paths(src.tree_edges(spark, d), src.tree_names(spark, d), regions, 3)


@query(f"with {_PATHS} select path, object_id, depth from paths")
def paths(spark, d):
    return _paths(spark, d)


@query("select '//' || r_name || '/./' || n_name || '/..' as wanted, 'nation/' || n_nationkey as object_id from region join nation on n_regionkey = r_regionkey")
def path_lookup(spark, d):
    regions, nations = table(spark, d, "region"), table(spark, d, "nation")
    wanted = regions.join(nations, nations.n_regionkey == regions.r_regionkey).select(F.concat(F.lit("//"), "r_name", F.lit("/./"), "n_name", F.lit("/..")).alias("path"))
    return namespace.lookup(_paths(spark, d), wanted)


@query(
    f"""with {S.TREE_EDGES}, {S.NAMES}, held as (select src as dir_id, name, arg_max(dst, (pos, dst)) as object_id from tree join names on object_id = dst group by 1, 2), dirs as (select distinct src from tree)
    select dir_id, (row_number() over (partition by dir_id order by name) + 1)::int as pos, name, object_id, object_id in (select src from dirs) as is_dir from held
    union all select src, 0, '.', src, true from dirs union all select src, 1, '..', '/', true from dirs"""
)
def readdir(spark, d):
    return namespace.readdir(src.tree_edges(spark, d), src.tree_names(spark, d))


@query("select 'document/' || doc_id as object_id, strlen(text)::bigint as size, ceil(strlen(text) / 512)::bigint as blocks, 33188 as mode from documents")
def stat(spark, d):
    return namespace.stat(_texts(spark, d).select("object_id", F.col("text").alias("content"), F.lit(False).alias("is_dir")))


@query(f"with {_PATHS}, s as (select 'order/' || o_orderkey as object_id, floor(o_totalprice)::bigint as size from orders), e as (select list_filter(string_split(path, '/'), lambda x: x <> '') as parts, coalesce(size, 0) as size, case when size is null then 0 else 1 end as file from paths left join s using (object_id)), u as (select '/' || array_to_string(parts[1:n], '/') as path, size, file from (select parts, size, file, unnest(range(1, len(parts) + 1)) as n from e)) select path, sum(file)::bigint as files, sum(size)::bigint as bytes from u group by 1")
def disk_usage(spark, d):
    sizes = table(spark, d, "orders").select(object_id("order", "o_orderkey").alias("object_id"), F.floor("o_totalprice").alias("size"))
    return namespace.usage(_paths(spark, d), sizes)


# Models


def _layers(spark, d):
    """Suppliers as layers of their nation's model; odd nations are tuned from the nation before and only have their richer suppliers' layers."""
    layers = table(spark, d, "supplier").where("s_nationkey % 2 = 0 or s_acctbal > 5000").select(F.col("s_nationkey").alias("model_id"), F.concat(F.lit("layer:"), F.pmod("s_suppkey", F.lit(20)).cast("string")).alias("layer"), F.col("s_name").alias("data"), "s_suppkey")
    layers = layers.groupBy("model_id", "layer").agg(F.max_by("data", "s_suppkey").alias("data"))
    return layers, table(spark, d, "nation").select(F.col("n_nationkey").alias("model_id"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey") - 1).alias("base_id"))


_LAYERS = "layers as (select s_nationkey as model_id, 'layer:' || (s_suppkey % 20) as layer, arg_max(s_name, s_suppkey) as data from supplier where s_nationkey % 2 = 0 or s_acctbal > 5000 group by 1, 2), models as (select n_nationkey as model_id, case when n_nationkey % 2 = 1 then n_nationkey - 1 end as base_id from nation)"


@query(f"with {_LAYERS} select model_id, layer, data, true as own from layers union all select m.model_id, b.layer, b.data, false from models m join layers b on b.model_id = m.base_id where not exists (select 1 from layers o where o.model_id = m.model_id and o.layer = b.layer)")
def layer_fallback(spark, d):
    return models.with_fallback(*_layers(spark, d))


@query(f"with {_LAYERS}, p as (select model_id, sum(strlen(data)) as stored from layers group by 1) select sum(case when base_id is null then coalesce(p.stored, 0) else coalesce(b.stored, 0) end)::bigint as full_bytes, sum(coalesce(p.stored, 0))::bigint as stored_bytes from models m left join p on p.model_id = m.model_id left join p b on b.model_id = m.base_id")
def delta_savings(spark, d):
    return models.savings(*_layers(spark, d))


@query("select model_id, session_id, layer, data, row_number() over (partition by model_id, session_id order by layer)::int as nth from (select event_type as model_id, user_id as session_id, strftime(ts, '%d') as layer, arg_max(props, event_id) as data from events group by 1, 2, 3)")
def session_cache(spark, d):
    return models.sessions(table(spark, d, "events").select(F.col("event_type").alias("model_id"), F.col("user_id").alias("session_id"), F.date_format("ts", "dd").alias("layer"), F.col("props").alias("data"), F.col("event_id").alias("seq")))


@query(f"with {_LAYERS} select m.model_id, base_id, count(layer) as n_layers from models m left join layers l on l.model_id = m.model_id group by 1, 2")
def model_store(spark, d):
    layers, known = _layers(spark, d)
    return known.join(layers, "model_id", "left").groupBy("model_id", "base_id").agg(F.count("layer").alias("n_layers"))


# Integrity


@query(
    f"""with {S.EDGES}, {S.OBJECTS}, tops as (select object_id from objects where object_id not in (select dst from tree))
    select (select count(*) from objects) as n_objects, (select count(*) from edges) as n_edges, (select 4 * count(*) from documents) as n_attributes, 0::bigint as duplicate_ids,
      (select count(*) from edges where dst not in (select object_id from objects)) as dangling_edges, (select count(*) from tops) as orphans, (select count(*) from edges where strength < 0 or strength > 1) as bad_strength,
      (select 4 * count(*) from documents) as stray_attributes, false as clean"""
)
def integrity_report(spark, d):
    """Attributes of documents are strays among the objects of the tree."""
    return integrity.report(src.objects(spark, d), src.edges(spark, d), src.document_attributes(spark, d))


@query("with r as (select sha256(text) as hash, count(*) as expected from documents group by 1), a as (select sha256(text) as hash, count(*) as refs from documents where doc_id in (select doc_id from labels) group by 1) select hash, expected, coalesce(refs, 0) as refs from r left join a using (hash) where expected <> coalesce(refs, 0)")
def ref_mismatch(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    count = lambda x: x.groupBy("hash").agg(F.count("*").alias("refs"))
    return integrity.reference_mismatch(count(docs), count(docs.join(table(spark, d, "labels"), "doc_id", "left_semi")))


@query("select c_nationkey::varchar as object_id, count(*) as n from customer group by 1 having count(*) > 1")
def duplicate_ids(spark, d):
    """Customers by the id of their nation, which is no key of theirs."""
    return integrity.duplicate_ids(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("object_id")))


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def checksum_mismatch(spark, d):
    """Checksums of toxic documents are falsified; they are what is found."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return integrity.checksum_mismatch(docs.select("doc_id", F.col("text").alias("payload"), (F.crc32(F.col("text").cast("binary")) + F.coalesce("toxic", F.lit(0))).alias("checksum"))).select("doc_id")
