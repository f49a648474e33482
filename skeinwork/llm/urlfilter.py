"""URL filters: host-suffix and path-prefix rules, found by hash prefix and confirmed by digest.

A URL is brought into one form: scheme, user, port and fragment go, the host becomes
small letters without outer or doubled dots, the path is unescaped once and its doubled
slashes become one. It is then expanded into expressions: its host and the
suffixes of it (two labels at least, and as many as any rule has at most; an IP address only whole), each with the
path and query, the path, and the prefixes of the path that end in a slash (as deep as any rule at most). A rule is such an expression,
as ``example.com/`` or ``a.example.com/x/``. Expressions meet rules by the first four bytes
of their SHA-256 in an equi-join; the full digests must then agree.

Of several rules the one with most host labels counts, then the longest path, then
one that allows before one that blocks, then the first in the alphabet.

Defined results: a null, empty or hostless URL matches no rule and passes. Every row is
judged, repeated rows alike. An empty rule table lets all pass. Rules with a null or
empty expression, or an action other than block and allow, take no part; repeated rules count once.
Extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: (expression, action, category): the rules of the query.
RULES = [
    ("adult-x.example.net/", "block", "adult"),
    ("ads-track.example.com/", "block", "tracking"),
    ("casino-win.example.com/", "block", "gambling"),
    ("casino-win.example.com/en/", "block", "gambling-en"),
    ("m.casino-win.example.com/de/", "allow", "reviewed"),
    ("cheap-pills.example.com/", "block", "pharmacy"),
    ("free-bets.example.com/", "block", "gambling"),
    ("spam-farm.example.com/", "block", "spam"),
    ("tionble.example.org/es/", "block", "section"),
    ("blog.tionsh.example.com/", "block", "hot host"),
    ("blog.tionsh.example.com/en/", "allow", "reviewed"),
]


def reach(rules: DataFrame) -> tuple[int, int]:
    """The most labels of any rule's host, and the most slashes of any rule's path (rule): no longer expression of a URL can be a rule."""
    host, path = F.substring_index("rule", "/", 1), F.regexp_extract("rule", "/([^?]*)", 0)
    found = rules.agg(F.max(F.size(F.split(host, "[.]"))), F.max(F.length(path) - F.length(F.replace(path, F.lit("/"))))).first()
    return found[0] or 0, found[1] or 0


def prepared(rules: DataFrame) -> DataFrame:
    """rules (expression, action, category) with digest, hash prefix and rank of precedence."""
    r = rules.select(F.trim("expression").alias("rule"), F.lower(F.trim(F.col("action"))).alias("action"), "category").where("rule <> '' AND action IN ('allow', 'block')")
    r = r.groupBy("rule", "action").agg(F.min("category").alias("category"))
    host = F.substring_index("rule", "/", 1)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    order = F.struct((-F.size(F.split(host, "[.]"))).alias("labels"), (-F.length(path)).alias("path"), "action", F.col("rule").alias("name"))
    digest = F.unhex(F.sha2("rule", 256))
    return r.select("rule", "action", "category", digest.alias("rule_digest"), F.substring(digest, 1, 4).alias("prefix"), order.alias("precedence"))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, "[.]{2,}", "."), "^[.]+|[.]+$", "")


def path_of(url: Column) -> Column:
    """Path and query."""
    rest = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*([?].*)?$", 1)
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(path, "[+]", "%2B")), path)
    return F.concat(F.regexp_replace(F.concat(F.lit("/"), plain), "/{2,}", "/"), query)


def expressions(url: Column, labels_most: int, slashes_most: int) -> Column:
    """The expressions of a URL, with suffixes and prefixes up to so many labels and slashes; none if it has no host."""
    host, full = host_of(url), path_of(url)
    labels = F.split(host, "[.]")
    # of so many labels, fewer than all
    suffix = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    few = F.transform(F.filter(F.array(*map(F.lit, range(labels_most, 1, -1))).cast("array<int>"), lambda n: (n < F.size(labels)) & ~host.rlike(r"^[0-9.]+$")), suffix)
    path = F.regexp_extract(full, r"^([^?]*)", 1)
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    deep = F.least(F.size(parts), F.lit(max(1, slashes_most)))
    ends = F.transform(F.sequence(F.lit(1), deep), lambda k: F.when(k == 1, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k - 1), "/"), F.lit("/"))))
    hosts = F.array_distinct(F.concat(F.array(host), few))
    paths = F.array_distinct(F.concat(F.array(full, path), ends))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(F.coalesce(F.length(host), F.lit(0)) > 0, both)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) to one row (url, rule, action, category) of the rule that counts for each distinct URL that matches any. The rules are broadcast if Spark knows them to be small, else both sides are shuffled by hash prefix."""
    known = cut(prepared(rules), "rules")
    wide = urls.distinct().select("url", F.explode(expressions(F.col("url"), *reach(known))).alias("expression"))
    hashed = wide.select("url", F.unhex(F.sha2("expression", 256)).alias("digest")).withColumn("prefix", F.substring("digest", 1, 4))
    found = hashed.join(known, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = found.groupBy("url").agg(F.min(F.struct("precedence", "rule", "action", "category")).alias("best"))
    return best.select("url", "best.rule", "best.action", "best.category")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: (page_id, url, verdict, rule, category), verdict being pass, allow or block."""
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    found = matches(own.where("url IS NOT NULL").select("url"), rules)
    return own.join(found, "url", "left").select("page_id", "url", F.coalesce("action", F.lit("pass")).alias("verdict"), "rule", "category")


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "expression string, action string, category string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_frame(spark))


_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in RULES)
SQL = rf"""
WITH rules AS (
  SELECT rule, action, category, -len(string_split(split_part(rule, '/', 1), '.')) AS labels, -(length(rule) - length(split_part(rule, '/', 1))) AS path
  FROM (VALUES {_VALUES}) AS v(rule, action, category)),
parsed AS (
  SELECT url,
    trim(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '[.]{{2,}}', '.', 'g'), '.') AS host,
    regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)', 1) AS rest
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
split_up AS (
  SELECT url, host, string_split(host, '.') AS labels,
    regexp_replace('/' || url_decode(regexp_extract(rest, '^([^?]*)', 1)), '/{{2,}}', '/', 'g') AS path,
    regexp_extract(rest, '^[^?]*([?].*)?$', 1) AS query
  FROM parsed WHERE host <> ''),
hosts AS (
  SELECT url, host AS h FROM split_up
  UNION SELECT url, array_to_string(labels[len(labels) - n + 1:], '.') FROM split_up, range(2, 6) AS r(n)
  WHERE n < len(labels) AND NOT regexp_full_match(host, '[0-9.]+')),
paths AS (
  SELECT url, path || query AS p FROM split_up
  UNION SELECT url, path FROM split_up
  UNION SELECT url, CASE WHEN k = 1 THEN '/' ELSE '/' || array_to_string(string_split(path[2:], '/')[1:k - 1], '/') || '/' END
  FROM split_up, range(1, 5) AS r(k) WHERE k <= len(string_split(path[2:], '/'))),
found AS (
  SELECT hosts.url, rule, action, category, row_number() OVER (PARTITION BY hosts.url ORDER BY rules.labels, rules.path, action, rule) AS k
  FROM hosts JOIN paths ON hosts.url = paths.url JOIN rules ON rule = h || p)
SELECT page_id, pages.url, coalesce(action, 'pass') AS verdict, rule, category
FROM pages LEFT JOIN found ON pages.url = found.url AND k = 1
"""
