"""URL filter by the reputation of hosts, with empirical-Bayes shrinkage.

Pages that carry a label are good or bad outcomes of their host. Each level borrows from the one
above it: a suffix from all pages, a registered domain from its suffix, a host from its domain. The strength
of each of the three beta-binomial priors is estimated by the moments of the rates on that level. A page
is dropped when the lower bound of its host's posterior rate of bad pages (the mean less Z standard deviations of the beta
posterior, a form that SQL has as well) exceeds `most_bad`.

Suffixes are the rules of the Public Suffix List (public_suffixes.txt, or a list of one's own), with its wildcards and exceptions:
the longest rule that a host ends in, an exception before all others, the last label where there is none. The
registered domain has one label more. An address of numbers is its own domain and suffix.

Aggregates by host are the only thing that is shuffled besides (page, url) itself, and they are made once and kept by a checkpoint; no table is broadcast by force.

Defined cases: empty tables of pages give an empty result. Without a host (null or malformed URL) the rate and bound are null and the page stays.
Hosts without labels get their domain's rate, with a wide bound. Without any labels all rates are null and all pages stay. Several
labels of one document count as the least of them. Repeated pages are each an outcome and each in the
result; ids may be null. Further columns are not read.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm.common import cut, table

#: Largest lower bound of a host's rate of bad pages that is let through; standard deviations to the bound; limits of a prior's strength.
MOST_BAD, Z, STRENGTH = 0.25, 1.645, (1.0, 1000.0)
_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
_IP = "^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$"
_DOCUMENT = "/[a-z][a-z]/([0-9]+)(?:[/.?#]|$)"


def read_suffixes(text: str) -> list[str]:
    """The rules of a list in the form of the Public Suffix List, those with other letters in their ASCII form as well."""
    rules = {r[0].lower() for line in text.splitlines() if (r := line.split()) and not r[0].startswith("//")}
    for r in list(rules):
        if not r.isascii():
            mark, name = re.match(r"(!|\*\.)?(.*)", r).groups()
            rules.add((mark or "") + ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split(".")))
    return sorted(rules)


SUFFIXES = read_suffixes((files("objectlake.llm") / "public_suffixes.txt").read_text("utf-8"))


def _last(k: Column) -> Column:
    """The last k labels of the host."""
    return F.call_function("substring_index", F.col("host"), F.lit("."), -k)


def registered(hosts: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """hosts with `suffix` and `domain` of each `host`."""
    spark = hosts.sparkSession
    rules = spark.createDataFrame([(r.lstrip("!*").lstrip("."), r[0] if r[0] in "!*" else "") for r in (SUFFIXES if suffixes is None else suffixes)], "tail string, kind string")
    rules = rules.groupBy("tail").agg(F.max(F.col("kind") == "!").alias("except"), F.max(F.col("kind") == "*").alias("wild"), F.max(F.col("kind") == "").alias("plain"))
    labels = F.split("host", "[.]")
    tails = hosts.select("host", F.size(labels).alias("n_labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k")).withColumn("tail", _last(F.col("k")))
    # labels of the suffix by each rule: an exception takes one off and wins, a wildcard adds one if there is another label
    found = tails.join(rules, "tail").groupBy("host").agg(F.max(F.when(F.col("except"), F.col("k") - 1)).alias("exception"), F.max(F.when(F.col("wild") & (F.col("k") < F.col("n_labels")), F.col("k") + 1).when(F.col("plain"), F.col("k"))).alias("longest"))
    n = F.coalesce("exception", "longest", F.lit(1))
    ip = F.col("host").rlike(_IP)
    tail = lambda k: F.when(ip, F.col("host")).otherwise(_last(k))
    return hosts.join(found, "host", "left").select(*[F.col(c) for c in hosts.columns], tail(n).alias("suffix"), tail(n + 1).alias("domain"))


def _strength(groups: DataFrame) -> DataFrame:
    """One row (rate, strength) of the groups' counts n and bad."""
    total = groups.where("n > 0").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    r, p, w = F.col("bad") / F.col("n"), F.col("all_bad") / F.col("all_n"), F.col("n") / F.col("all_n")
    sums = groups.where("n > 0").crossJoin(total).agg(F.first("all_n").alias("all_n"), F.first("all_bad").alias("all_bad"), F.sum(w * (r - p) * (r - p)).alias("s"), F.sum(w * (1 - w) / F.col("n")).alias("u"), F.sum(w * (1 - w)).alias("v"))
    rate = F.col("all_bad") / F.col("all_n")
    noise = rate * (1 - rate)
    rho = F.when((noise > 0) & (F.col("v") > F.col("u")), (F.col("s") - noise * F.col("u")) / (noise * (F.col("v") - F.col("u")))).otherwise(0.0)
    low, high = 1 / (1 + STRENGTH[1]), 1 / (1 + STRENGTH[0])
    rho = F.least(F.greatest(rho, F.lit(low)), F.lit(high))
    return sums.select(rate.alias("rate"), ((1 - rho) / rho).alias("strength"))


def _shrunk(bad: str, n: str, strength: str, prior: Column) -> Column:
    return (F.col(bad) + F.col(strength) * prior) / (F.col(n) + F.col(strength))


def reputation(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", id_col: str = "doc_id", label_col: str = "quality", document: Column | None = None, most_bad: float = MOST_BAD, suffixes: list[str] | None = None) -> DataFrame:
    """(page_id, host, labelled, bad_rate, bound, keep) for each page; `document`: the labelled document of a page, by default the number in its URL."""
    url = F.col(url_col)
    own = pages.select(F.col(page_col).cast("long").alias("page_id"), F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit("")).alias("host"), (F.nullif(F.regexp_extract(url, _DOCUMENT, 1), F.lit("")).try_cast("long") if document is None else document).alias("document"))
    outcome = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("document")).agg(F.min(label_col).cast("int").alias("good"))
    hosts = own.where("host is not null").join(outcome, "document", "left").groupBy("host").agg(F.count("good").alias("n"), F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad"))
    hosts = cut(registered(hosts, suffixes))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level1 = suffixes.crossJoin(_strength(suffixes)).select("suffix", _shrunk("bad", "n", "strength", F.col("rate")).alias("prior"))
    level2 = domains.crossJoin(_strength(domains).select("strength")).join(level1, "suffix").select("suffix", "domain", _shrunk("bad", "n", "strength", F.col("prior")).alias("prior"))
    level3 = hosts.crossJoin(_strength(hosts).select("strength")).join(level2, ["suffix", "domain"])
    rate = _shrunk("bad", "n", "strength", F.col("prior"))
    judged = level3.select("host", "n", rate.alias("rate"), (rate - Z * F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("strength") + 1))).alias("low"))
    return own.join(judged, "host", "left").select("page_id", "host", F.coalesce("n", F.lit(0)).cast("long").alias("labelled"), F.round("rate", 6).alias("bad_rate"), F.when(F.col("low").isNotNull(), F.round(F.greatest("low", F.lit(0.0)), 6)).alias("bound"), F.coalesce(F.round("low", 6) <= most_bad, F.lit(True)).alias("keep"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _strength_sql(groups: str) -> str:
    low, high = 1 / (1 + STRENGTH[1]), 1 / (1 + STRENGTH[0])
    return f"""(select p as rate, (1 - rho) / rho as strength from (
      select p, least(greatest(case when p * (1 - p) > 0 and v > u then (s - p * (1 - p) * u) / (p * (1 - p) * (v - u)) else 0.0 end, {low!r}), {high!r}) as rho from (
        select any_value(p) as p, sum(n / nn * (bad / n - p) * (bad / n - p)) as s, sum(n / nn * (1 - n / nn) / n) as u, sum(n / nn * (1 - n / nn)) as v
        from (select cast(n as double) as n, cast(bad as double) as bad from {groups} where n > 0) g,
             (select cast(sum(n) as double) as nn, cast(sum(bad) as double) / sum(n) as p from {groups} where n > 0) t)))"""


SQL = f"""
with own as (
  select page_id, nullif(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') as host, try_cast(nullif(regexp_extract(url, '{_DOCUMENT}', 1), '') as bigint) as document from pages),
outcome as (select doc_id as document, min(quality) as good from labels where quality is not null group by doc_id),
host_counts as (
  select host, count(good) as n, count(case when good = 0 then 1 end) as bad from own left join outcome using (document) where host is not null group by host),
rules as (
  select ltrim(ltrim(r, '!*'), '.') as tail, bool_or(r[1] = '!') as except_, bool_or(r[1] = '*') as wild, bool_or(r[1] not in ('!', '*')) as plain
  from (select unnest(string_split('{" ".join(SUFFIXES)}', ' ')) as r) group by 1),
parts as (select host, string_split(host, '.') as labels from host_counts),
tails as (select host, len(labels) as n_labels, k, array_to_string(list_slice(labels, len(labels) - k + 1, len(labels)), '.') as tail from (select *, unnest(range(1, len(labels) + 1)) as k from parts)),
found as (
  select host, max(case when except_ then k - 1 end) as exception, max(case when wild and k < n_labels then k + 1 when plain then k end) as longest
  from tails join rules using (tail) group by host),
sized as (select host, coalesce(exception, longest, 1) as k from found right join host_counts using (host)),
hosts as (
  select host_counts.*, case when regexp_matches(host, '{_IP}') then host else array_to_string(list_slice(labels, greatest(len(labels) - k + 1, 1), len(labels)), '.') end as suffix,
    case when regexp_matches(host, '{_IP}') then host else array_to_string(list_slice(labels, greatest(len(labels) - k, 1), len(labels)), '.') end as domain
  from host_counts join parts using (host) join sized using (host)),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by suffix, domain),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by suffix),
level1 as (select suffix, (bad + strength * rate) / (n + strength) as prior from suffixes, {_strength_sql("suffixes")}),
level2 as (select suffix, domain, (bad + strength * prior) / (n + strength) as prior from domains join level1 using (suffix), {_strength_sql("domains")}),
level3 as (select host, n, strength, (bad + strength * prior) / (n + strength) as rate from hosts join level2 using (suffix, domain), {_strength_sql("hosts")}),
judged as (select host, n, rate, rate - {Z} * sqrt(rate * (1 - rate) / (n + strength + 1)) as low from level3)
select page_id, host, cast(coalesce(n, 0) as bigint) as labelled, round(rate, 6) as bad_rate, case when low is not null then round(greatest(low, 0.0), 6) end as bound, coalesce(round(low, 6) <= {MOST_BAD}, true) as keep
from own left join judged using (host)
"""
