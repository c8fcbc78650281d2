"""URL filters: host and path rules, and a listed-URL check by blocked Bloom filter and exact join.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spread import hot_keys, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words that make a host's label one of an unwanted site; a parameter of listed_sites.
UNWANTED = ("bets", "casino", "pills", "adult", "spam", "track")

#: Query parameters that mark a URL as an affiliate's; a parameter of listed_pages.
AFFILIATE = ("ref", "aff", "affid")

#: Characters that the host of a listed site has at most.
LONGEST_HOST = 253

#: Bytes up to which the Bloom filter is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 16 << 20
_WORDS, _BITS_PER_KEY = 4, 16


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does.

    A rule fits its host and that host's subdomains if the path starts with its own.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(host: Column, path: Column) -> Column:
    """Host without user, port, final dot and a leading ``www.``, and path with single slashes and none at its end; the site itself is ``host/``.

    Scheme, query and fragment have no part in it, so all such variants of a page are one.
    """
    bare = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", ""), r"^www\.", "")
    return F.concat(site, F.when(bare == "", "/").otherwise(bare))


def sites_of(host: Column) -> Column:
    """``suffix/`` for the host and each parent domain of two labels or more.

    Of a host of more than LONGEST_HOST characters only the end can be a listed site, so a row has bounded keys.
    """
    end = F.substring(host, -LONGEST_HOST - 1, LONGEST_HOST + 1)
    labels = F.split(F.when(F.length(host) > LONGEST_HOST, F.regexp_replace(end, r"^[^.]*\.?", "")).otherwise(host), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, n), "."), F.lit("/")))


def _place(key: Column, blocks: int) -> list[Column]:
    """The key's block and, for each of the block's words, its two bits."""
    bits = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), *(bit(2 * w).bitwiseOR(bit(2 * w + 1)).alias(f"_w{w}") for w in range(_WORDS))]


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of column ``key``: a row per block of 256 bits, two bits of each of its words for a key."""
    blocks = max(1, -(-n * _BITS_PER_KEY // (64 * _WORDS)))
    return keys.select(*_place(F.col("key"), blocks)).groupBy("_block").agg(*(F.bit_or(f"_w{w}").alias(f"_f{w}") for w in range(_WORDS))), blocks


def hits(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose ``key`` is in ``listed``: Bloom filter first, exact hash join after.

    The filter has at most 32 bytes a block, known before it is built; up to BROADCAST_BYTES it is
    broadcast. ``listed`` needs unique keys; null keys hit nothing.
    """
    filter_, blocks = bloom(listed, listed.count())
    if blocks * 8 * (_WORDS + 1) <= BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    marked = keys.where(F.col("key").isNotNull()).select("*", *_place(F.col("key"), blocks))
    passes = [F.col(f"_f{w}").bitwiseAND(F.col(f"_w{w}")) == F.col(f"_w{w}") for w in range(_WORDS)]
    possible = marked.join(filter_, "_block").where(passes[0] & passes[1] & passes[2] & passes[3]).select(*keys.columns)
    return possible.join(listed.select("key"), "key", "left_semi")


def listed_sites(urls: DataFrame, unwanted=UNWANTED) -> DataFrame:
    """A block list from the URLs at hand: ``key`` is each site whose first label of three or more (of two, if that is all) has an unwanted word."""
    site = F.regexp_extract("_host", r"([^.]+\.[^.]+\.[^.]+|^[^.]+\.[^.]+)$", 1)
    label = F.regexp_extract("_site", r"^([^.]*)", 1)
    hosts = urls.select(host(F.col("url")).alias("_host")).distinct().select(site.alias("_site")).where(F.length("_site").between(1, LONGEST_HOST))
    return hosts.where(F.arrays_overlap(F.split(label, "-"), F.array(*map(F.lit, unwanted)))).select(F.concat("_site", F.lit("/")).alias("key")).distinct()


def listed_pages(urls: DataFrame, affiliate=AFFILIATE, rules=RULES) -> DataFrame:
    """A block list from the URLs at hand: ``key`` is the canonical form of each URL that a rule blocks or an affiliate's query marks.

    So other forms of such a page are found too: another scheme or port, ``www.``, slashes, another query or none.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    query = F.coalesce(F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    marked = query.rlike(f"(^|&)({'|'.join(affiliate)})=")
    return urls.where((h != "") & (marked | (rule_for(h, p, rules)["verdict"] == "block"))).select(canonical(h, p).alias("key")).distinct()


def filter_urls(df: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``df`` with url_host, url_path, rule and verdict (``allow`` or ``block``).

    The longest fitting rule decides. Without one, the URL is blocked if its canonical form, its
    site or a parent domain is in ``listed`` (column ``key``; it may be empty), else allowed. Null URLs and those
    without ``://`` have an empty host and path, fit no rule and are allowed. Rows that repeat
    stay; the four columns replace ones of their names; an empty table gives an empty one. Very long hosts have bounded keys (see sites_of),
    very long paths one key. Lookups run over distinct hosts
    and distinct URLs, so one host with a third of all rows is looked up once; what is found goes back to the rows by
    joins that deal hot hosts and hot URLs over salts.
    """
    df = df.drop("url_host", "url_path", "rule", "verdict").withColumns({"url_host": host(F.col(url)), "url_path": path(F.col(url))})
    listed = listed.select("key").where("key is not null").distinct()
    hosts, pages = df.select("url_host").distinct(), df.select("url_host", "url_path").distinct()
    sites = hosts.select("url_host", F.lit(None).cast("string").alias("url_path"), F.explode(sites_of(F.col("url_host"))).alias("key"))
    found = hits(sites.unionByName(pages.withColumn("key", canonical(F.col("url_host"), F.col("url_path")))), listed)
    site = found.where("url_path is null").select("url_host").distinct().withColumn("_site", F.lit(True))
    page = found.where("url_path is not null").select("url_host", "url_path").distinct().withColumn("_page", F.lit(True))
    ruled = rule_for(F.col("url_host"), F.col("url_path"), rules)
    method = F.when(F.coalesce("_site", "_page", F.lit(False)), "block").otherwise("allow")
    of_page = df.groupBy("url_host", "url_path").count()
    of_host = of_page.groupBy("url_host").agg(F.sum("count").alias("count"))
    total = df.count()
    whole = F.struct(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t))
    out = salted_join(df, site, ["url_host"], hot_keys(of_host, ["url_host"], "count", total), whole, "left")
    out = salted_join(out, page, ["url_host", "url_path"], hot_keys(of_page, ["url_host", "url_path"], "count", total), whole, "left")
    out = out.withColumn("_ruled", ruled)
    return out.withColumns({"rule": F.col("_ruled.rule"), "verdict": F.coalesce("_ruled.verdict", method)}).drop("_ruled", "_site", "_page")


def digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    pages = pages.select("page_id", "url")
    out = filter_urls(pages, listed_sites(pages).union(listed_pages(pages)))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), "rule", "verdict")


#: The same in DuckDB.
SQL = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path,
         regexp_matches(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '(^|&)(ref|aff|affid)=') as marked
  from pages),
r as (
  select p.*, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+|^[^.]+\.[^.]+)$', 1) as site,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', ''), '^www\.', '')
      || case when rtrim(path, '/') = '' then '/' else regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') end as page,
    case
      when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from p),
sites as (
  select distinct site from r where length(site) between 1 and 253
    and list_has_any(string_split(regexp_extract(site, '^([^.]*)', 1), '-'), ['bets', 'casino', 'pills', 'adult', 'spam', 'track'])),
listed as (select distinct page from r where host <> '' and (marked or rule in ('example.com/en/', 'net/es/', 'net/fr/')))
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow'
    when rule is not null then 'block'
    when page in (select page from listed) then 'block'
    when exists (select 1 from sites where r.host = site or ends_with(r.host, '.' || site)) then 'block'
    else 'allow' end as verdict
from r
"""
