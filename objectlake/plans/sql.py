"""Pieces of SQL that the oracle queries share."""

TOKENS = r"""list_filter(regexp_split_to_array(lower({0}), '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}!-/:-@\[-`{{-~]+'), lambda x: x <> '')"""

TREE_EDGES = """
tree as (
  select 'region/' || n_regionkey as src, n_nationkey as pos, 'nation/' || n_nationkey as dst, 'contains' as kind, 1.0::double as strength from nation
  union all select 'nation/' || c_nationkey, c_custkey::int, 'customer/' || c_custkey, 'contains', 1.0 from customer
  union all select 'customer/' || o_custkey, o_orderkey::int, 'order/' || o_orderkey, 'contains', 1.0 from orders)"""

EDGES = (
    TREE_EDGES
    + """,
edges as (
  select * from tree
  union all select 'order/' || l_orderkey, l_linenumber, 'part/' || l_partkey, 'depends_on', l_quantity / 50 from lineitem
  union all select 'order/' || l_orderkey, l_linenumber, 'supplier/' || l_suppkey, 'references', 1.0 from lineitem)"""
)

OBJECTS = """
objects as (
  select 'region/' || r_regionkey as object_id from region union all select 'nation/' || n_nationkey from nation
  union all select 'customer/' || c_custkey from customer union all select 'order/' || o_orderkey from orders
  union all select 'part/' || p_partkey from part union all select 'supplier/' || s_suppkey from supplier)"""

NAMES = """
names as (
  select 'region/' || r_regionkey as object_id, r_name as name from region union all select 'nation/' || n_nationkey, n_name from nation
  union all select 'customer/' || c_custkey, c_name from customer union all select 'order/' || o_orderkey, o_orderkey::varchar from orders)"""

ATTRIBUTES = """
attributes as (
  select 'document/' || doc_id as object_id, 'content' as name, 'string' as tag, text as v_string, null::bigint as v_long, null::double as v_double from documents
  union all select 'document/' || doc_id, 'language', 'string', lang, null, null from documents
  union all select 'document/' || doc_id, 'source', 'string', source, null, null from documents
  union all select 'document/' || doc_id, 'n_chars', 'int64', null, n_chars, null from documents
  union all select 'page/' || page_id, 'name', 'string', url, null, null from pages
  union all select 'page/' || page_id, 'content', 'string', html, null, null from pages
  union all select 'event/' || event_id, 'intent', 'string', event_type, null, null from events
  union all select 'event/' || event_id, 'value', 'float64', null, null, value from events
  union all select 'event/' || event_id, 'content', 'string', props, null, null from events)"""

LOG = """
log as (select event_id as seq, event_type as object_id, user_id as session, ts, case when event_type = 'purchase' then 'write' else 'read' end as access_type from events)"""

TEXTS = """
texts as (
  select 'document/' || doc_id as object_id, text as content from documents
  union all select 'page/' || page_id, html from pages
  union all select 'url/' || page_id, url from pages
  union all select 'event/' || event_id, props from events
  union all select 'turn/' || conv_id || '/' || turn, text from conversations)"""

CONTENT_TYPE = """case
  when strlen(content) < 4 then 'application/octet-stream'
  when substr(content, 1, 4) = '%PDF' then 'application/pdf'
  when substr(content, 1, 4) = 'GIF8' then 'image/gif'
  when not regexp_full_match(content, '[\\x21-\\x7E \\t\\n\\f\\r]*') then 'application/octet-stream'
  when substr(content, 1, 3) = '---' or contains(content, 'title:') then 'text/yaml'
  when substr(content, 1, 1) = '#' or substr(content, 1, 2) in ('//', '/*') then 'text/plain'
  when substr(content, 1, 5) = '<?xml' or substr(content, 1, 2) = '<!' then 'text/xml'
  when substr(content, 1, 1) in ('{', '[') then 'application/json'
  else 'text/plain' end"""

LANGUAGE = """case
  when contains(lower({0}), ' the ') or contains(lower({0}), ' of ') then 'en'
  when contains(lower({0}), ' el ') or contains(lower({0}), ' la ') or contains(lower({0}), ' de ') then 'es'
  when contains(lower({0}), ' le ') or contains(lower({0}), ' et ') or contains(lower({0}), ' de ') then 'fr'
  when contains(lower({0}), ' der ') or contains(lower({0}), ' die ') or contains(lower({0}), ' und ') then 'de' end"""

SUMMARY_FIRST = "list_filter(list_transform(string_split({0}, '.'), lambda p: trim(p, e' \\n\\t\\r')), lambda p: p <> '')[1]"


def summary(text: str) -> str:
    first = SUMMARY_FIRST.format(text)
    return f"""coalesce(case when strlen({first}) <= 200 then {first} else
      substr({first}, 1, list_max(list_filter(range(0, 201), lambda n: n <= length({first}) and strlen(substr({first}, 1, n)) <= 200))) || '...' end, '(no text)')"""


def keyword_tags(text: str) -> str:
    from objectlake.functions.text import KEYWORDS

    each = ", ".join(f"case when {' or '.join(f"contains(lower({text}), '{w}')" for w in ws)} then '{k}' end" for k, ws in KEYWORDS.items())
    return f"list_filter([{each}], lambda x: x is not null)"


TYPE_TAGS = "case {0} when 'application/json' then ['data', 'json'] when 'application/pdf' then ['document', 'pdf'] when 'image/gif' then ['image'] when 'text/plain' then ['text'] else [] end"
