"""URL filter with redirect equivalence, in DataFrame operations only.

Rules (host, path prefix, verdict) decide urls directly: the longest rule that
fits wins, and an explicit allow is kept whatever else holds. Redirect and
canonical-link edges, and urls that differ only in scheme, ``www.``, fragment
or a closing slash, join urls into groups of aliases. A url without a rule is
blocked if any url of its group, fetched or only linked, is blocked by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest host and path that rules are looked up for, as lists of suffixes.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TAG = r"(?is)<{}\s[^>]*>"
ATTRIBUTE = r"""(?is)\s{}\s*=\s*["']?\s*([^"'\s>]+)"""
REL = r"""(?is)\srel\s*=\s*["']?[^"'>]*\bcanonical\b"""
EQUIV = r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
REFRESH = r"""(?is)[;,\s"']url\s*=\s*["']?\s*([^"'\s>]+)"""
#: Character references that urls are written with.
ENTITIES = (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#58;", ":"), ("&#x3a;", ":"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host and path of the url column."""
    u = F.col("__u")
    return df.withColumn("__u", F.col(url)).withColumn("host", host_of(u)).withColumn("path", path_of(u)).drop("__u")


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (host, path) with rule and decision of the longest fitting rule.

    A rule's length is that of host and path together; of equal ones the
    longer host wins. Hosts that are empty fit no rule.
    """
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        decision = F.when(fits, F.lit(verdict)).otherwise(decision)
    return df.withColumn("rule", rule).withColumn("decision", decision)


def alias_key(url: Column) -> Column:
    """A url without scheme, ``www.``, fragment and closing slashes; null if none is left."""
    bare = F.regexp_replace(url, r"(?s)^[^:]*://(?i:www\.)?|#.*$", "")
    host = F.translate(F.regexp_extract(bare, r"^([^/?]*)", 1), UPPER, LOWER)
    rest = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1), r"/+(?=\?|$)", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, rest))


def resolved(target: Column, base: Column) -> Column:
    """The url a link target stands for in a page of url ``base``.

    Null where the target is relative and the base has no ``://``, and for
    targets of other schemes without ``//``.
    """
    site = F.regexp_extract(base, r"(?s)^([^:]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    given = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    whole = F.when(given == "", path).when(given.startswith("/"), given).otherwise(F.concat(F.regexp_replace(path, r"[^/]*$", ""), given))
    parts = F.split(F.regexp_replace(whole, "^/", ""), "/")
    # Steps up take the part before them off; a last step leaves a directory.
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    closing = F.when(whole.rlike(r"(^|/)\.\.?$") & (F.size(up) > 0), "/").otherwise("")
    joined = F.concat(site, F.lit("/"), F.array_join(up, "/"), closing, tail)
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(site != "", joined)
    )


def _unescaped(text: Column) -> Column:
    for coded, plain in ENTITIES:
        text = F.regexp_replace(text, f"(?i){coded}", plain)
    return text


def page_edges(pages: DataFrame) -> DataFrame:
    """source and target url of every canonical link and refresh of each page.

    Relative targets are resolved against the page's first ``<base href>``, or
    its url.
    """
    tags = lambda name: F.regexp_extract_all("html", F.lit(TAG.format(name)), 0)
    value = lambda tag, pattern: _unescaped(F.regexp_extract(tag, pattern, 1))
    links = F.transform(F.filter(tags("link"), lambda t: t.rlike(REL)), lambda t: value(t, ATTRIBUTE.format("href")))
    moves = F.transform(F.filter(tags("meta"), lambda t: t.rlike(EQUIV)), lambda t: value(t, REFRESH))
    based = value(F.regexp_extract("html", TAG.format("base"), 0), ATTRIBUTE.format("href"))
    found = pages.filter("url is not null and html is not null").select("url", based.alias("based"), F.explode(F.concat(links, moves)).alias("t")).filter("t <> ''")
    found = found.withColumn("based", F.when(F.col("based") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("based"), F.col("url")), F.col("url"))))
    return found.select(F.col("url").alias("source"), resolved(F.col("t"), F.col("based")).alias("target")).filter("target is not null")


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and reason of each page row.

    ``edges`` (source, target) adds redirects known from elsewhere. Null urls
    and urls without ``://`` have empty parts, no rule, and are allowed; null
    or empty html has no edges, long html is read whole. Rows that repeat are
    judged alike and kept, an empty table gives no rows; of rules of one length
    the longer host wins. Columns other than page_id, url and html are not
    read, whatever their names. The pages are read for their edges and for their verdicts; what
    is shuffled is keys of linked urls, not pages.
    """
    pages = pages.select("page_id", "url", "html")
    links = page_edges(pages)
    links = links if edges is None else links.unionByName(edges.select("source", "target"))
    links = stored(links.filter("source is not null and target is not null").distinct(), "url-edges")
    judged = with_rule(with_parts(pages.select("page_id", "url")), rules).withColumn("key", alias_key(F.col("url")))
    ends = links.select(F.col("source").alias("url")).unionByName(links.select(F.col("target").alias("url")))
    ends = with_rule(with_parts(ends), rules).withColumn("key", alias_key(F.col("url"))).select("key", "decision")
    groups = components(links.select(alias_key(F.col("source")).alias("u"), alias_key(F.col("target")).alias("v")).filter("u is not null and v is not null"))
    bad = judged.select("key", "decision").unionByName(ends).filter("decision = 'block' and key is not null").select("key").distinct()
    # A key is its own group unless an edge joins it with others.
    grouped = bad.join(groups, bad["key"] == groups["node"], "left").select(F.coalesce("component", "key").alias("component")).distinct()
    members = grouped.join(groups, "component", "left").select(F.explode(F.array_distinct(F.array_compact(F.array("component", "node")))).alias("key")).distinct()
    # Rows without a key, or with a rule, have nothing to look up, and are not dealt by it.
    open_rows = judged.filter("decision is null and key is not null").join(members.withColumn("aliased", F.lit(True)), "key", "left")
    out = open_rows.unionByName(judged.filter("decision is not null or key is null").withColumn("aliased", F.lit(None).cast("boolean")))
    verdict = F.coalesce("decision", F.when(F.col("aliased"), "block").otherwise("allow"))
    reason = F.when(F.col("decision").isNotNull(), "rule").when(F.col("aliased"), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), reason.alias("reason"))


def _sql_resolved(target: str, base: str) -> str:
    """DuckDB's form of :func:`resolved`."""
    site, path = f"regexp_extract({base}, '(?s)^([^:]*://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^[^:]*://[^/?#]*([^?#]*)', 1)"
    tail, given = f"regexp_extract({target}, '(?s)([?#].*)$', 1)", f"regexp_extract({target}, '(?s)^([^?#]*)', 1)"
    whole = f"(CASE WHEN {given} = '' THEN {path} WHEN starts_with({given}, '/') THEN {given} ELSE regexp_replace({path}, '[^/]*$', '') || {given} END)"
    up = f"""list_reduce(list_transform(string_split(regexp_replace({whole}, '^/', ''), '/'), lambda x: [x]), lambda done, x:
      CASE WHEN x[1] = '..' THEN done[1:greatest(len(done) - 1, 0)] WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END, []::VARCHAR[])"""
    closing = f"CASE WHEN regexp_matches({whole}, '(^|/)\\.\\.?$') AND len({up}) > 0 THEN '/' ELSE '' END"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target}
      WHEN starts_with({target}, '//') THEN regexp_extract({base}, '^([^:]*:)', 1) || {target}
      WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN {site} <> '' THEN {site} || '/' || array_to_string({up}, '/') || {closing} || {tail} END"""


def _sql_unescaped(text: str) -> str:
    for coded, plain in ENTITIES:
        text = f"regexp_replace({text}, '(?i){coded}', '{plain}', 'g')"
    return text


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KEY = """translate(regexp_extract(bare, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1), '/+(\\?|$)', '\\1')"""
_BARE = "CASE WHEN instr(url, '://') > 0 THEN regexp_replace(url, '(?s)^[^:]*://((?i)www\\.)?|#.*$', '', 'g') END"
_HREF = _sql_unescaped(f"regexp_extract(tag, {_quoted(ATTRIBUTE.format('href'))}, 1)")
#: The same over ``pages``; edges come from the pages alone, and blocks are
#: passed on along them until no url is new.
SQL = f"""
WITH RECURSIVE rules(rhost, rpath, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
linked AS (
  SELECT url, t, based FROM (
    SELECT url, {_sql_unescaped(f"regexp_extract(regexp_extract(html, {_quoted(TAG.format('base'))}), {_quoted(ATTRIBUTE.format('href'))}, 1)")} AS based,
      unnest(list_concat(
        list_transform(list_filter(regexp_extract_all(html, {_quoted(TAG.format('link'))}), lambda tag: regexp_matches(tag, {_quoted(REL)})), lambda tag: {_HREF}),
        list_transform(list_filter(regexp_extract_all(html, {_quoted(TAG.format('meta'))}), lambda tag: regexp_matches(tag, {_quoted(EQUIV)})), lambda tag: {_sql_unescaped(f"regexp_extract(tag, {_quoted(REFRESH)}, 1)")}))) AS t
    FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) WHERE t <> ''),
placed AS (SELECT url, t, CASE WHEN based = '' THEN url ELSE coalesce({_sql_resolved("based", "url")}, url) END AS base FROM linked),
edges AS (SELECT DISTINCT url AS source, target FROM (SELECT url, {_sql_resolved("t", "base")} AS target FROM placed) WHERE target IS NOT NULL),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT source FROM edges UNION SELECT target FROM edges),
parts AS (
  SELECT url, {_BARE} AS bare,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END AS rest FROM urls)),
keyed AS (
  SELECT p.*, {_KEY} AS key, r.rhost || r.rpath AS rule, r.verdict AS decision FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) = 1),
steps AS (
  SELECT a.key AS u, b.key AS v FROM edges JOIN keyed a ON a.url = source JOIN keyed b ON b.url = target WHERE a.key IS NOT NULL AND b.key IS NOT NULL),
both_ways AS (SELECT u, v FROM steps UNION SELECT v, u FROM steps),
bad(key) AS (
  SELECT DISTINCT key FROM keyed WHERE decision = 'block' AND key IS NOT NULL
  UNION SELECT v FROM bad JOIN both_ways ON u = key)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(decision, CASE WHEN key IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN decision IS NOT NULL THEN 'rule' WHEN key IN (SELECT key FROM bad) THEN 'alias' ELSE 'default' END AS reason
FROM pages LEFT JOIN keyed USING (url)
"""
