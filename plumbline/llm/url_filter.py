"""URL filters: host and path rules, and redirect equivalence between aliases. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import components, spare, table

#: The rules of the registered query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules up to this number are one expression; more of them are joined.
EXPRESSED = 200


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule of a short list as struct(rule, verdict), or null: one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def joined_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, path, rule, verdict) of the distinct places(host, path) that a rule of rules(verdict, rule) fits, with the longest.

    A place's host and each parent domain meet the rules' hosts in an equi-join; for those found, the path's beginnings of the lengths
    that the host's rules have meet the rules. So the work grows with places and labels, not with places times rules. Of two verdicts
    for one rule, allow counts.
    """
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict")).where("instr(rule, '/') > 0")
    cut = F.instr("rule", "/")
    rules = rules.select("rule", "verdict", F.substring("rule", F.lit(1), cut - 1).alias("name"), F.substring("rule", cut, F.length("rule")).alias("start"))
    lengths = rules.groupBy("name").agg(F.collect_set(F.length("start")).alias("lengths"))  # as many as paths have lengths
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = places.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("name"))
    each = each.join(lengths, "name").select("host", "path", "name", F.explode("lengths").alias("n")).where("n <= length(path)")
    found = each.select("host", "path", "name", F.substring("path", F.lit(1), F.col("n")).alias("start")).join(rules, ["name", "start"])
    return found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("r")).select("host", "path", "r.*")


def ruled(rows: DataFrame, host: str, path: str, rules, name: str) -> DataFrame:
    """rows with a column name: the longest rule fitting host and path as struct(rule, verdict), or null. rules: pairs (verdict, rule), or a DataFrame of them for lists of any length."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= EXPRESSED:
            return rows.withColumn(name, rule_of(F.col(host), F.col(path), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    found = joined_rules(rows.select(F.col(host).alias("host"), F.col(path).alias("path")), rules)
    found = found.select(F.col("host").alias(name + "_h"), F.col("path").alias(name + "_p"), F.struct("rule", "verdict").alias(name))
    return rows.join(found, (rows[host] == found[name + "_h"]) & (rows[path] == found[name + "_p"]), "left").drop(name + "_h", name + "_p")


def node_of(url: Column) -> Column:
    """One node for the spellings of a resource: without scheme and fragment, host in lower case."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^#]*)", 1), F.lit("")))


def decoded(text: Column) -> Column:
    """Character references of an attribute as characters: numeric ones, and the names of the five signs that markup needs."""
    def number(ref: Column) -> Column:
        hexed = F.when(ref.rlike("^&#[xX]"), F.regexp_extract(ref, "([0-9A-Fa-f]+)", 1)).otherwise(F.hex(F.regexp_extract(ref, "([0-9]+)", 1).cast("long")))
        return F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[xX](?:10|[0-9A-Fa-f])[0-9A-Fa-f]{0,4}|[0-9]{1,6});"), F.lit(0)))
    out = F.aggregate(refs, text, lambda acc, ref: F.replace(acc, ref, number(ref)))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def normal_path(path: Column) -> Column:
    """A path without steps . and .., which go up at most to the root."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.element_at(parts, -1).isin(".", "..")
    plain = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.when(last & (F.length(plain) > 1), F.concat(plain, F.lit("/"))).otherwise(plain)).otherwise(path)


#: A link, meta or base tag: quoted values can hold any sign; where quotes do not pair, it ends at the next >. A tag that is not closed before
#: the next < is none, so each sign is looked at a few times only. An attribute: its name, and its value with quotes.
TAG = r"""(?is)<(?:link|meta|base)(?=[\s/>])(?:(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+>)"""
ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out at this place of the plan. Expressions that use a column many times would otherwise each repeat what it is made of."""
    made = rows.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_settled"))
    return made.select(*(c for c in rows.columns if c not in columns), *(F.col("_settled")[n].alias(n) for n in columns))


def attribute(names: Column, values: Column, name: str) -> Column:
    """The value of a tag's first attribute of the name, of its attributes' lower-case names and quoted values; null without one."""
    found = F.try_element_at(values, F.nullif(F.array_position(names, name).cast("int"), F.lit(0)))
    return F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2")


def names_and_values(tag: Column) -> tuple[Column, Column]:
    """The lower-case names of a tag's attributes, and their values with quotes, empty where there is none."""
    inside = F.regexp_replace(tag, r"^<\w+", "")
    return F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), F.lower), F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(2))


def resolved(base: Column, href: Column) -> Column:
    """A reference as an absolute URL, by the URL that it stands in."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    own, rest = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(site, normal_path(own), rest))
        .when(href.startswith("?"), F.concat(site, path_of(base), rest))
        .otherwise(F.concat(site, normal_path(F.concat(folder, own)), rest))
    )


def links(pages: DataFrame) -> DataFrame:
    """Edges (url, target) from canonical links and refresh redirects in html, targets made absolute, by the page's base element if it has one.

    Comments, scripts and other raw text hold no links. Pages without url or html give none; nor does a url or target without host."""
    seen = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|noscript|template|xmp)\b.*?(?:</\1\s*>|\z)", " ")
    own = pages.where(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").contains("://") & (host_of(F.col("url")) != ""))
    own = settled(own.select("url", "html"), tags=F.regexp_extract_all(seen, F.lit(TAG), F.lit(0))).drop("html")
    bases = F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: F.trim(decoded(attribute(*names_and_values(t), "href"))))
    own = settled(own, base=F.get(F.filter(bases, lambda h: F.coalesce(h, F.lit("")) != ""), F.lit(0)))
    own = settled(own, base=F.when(F.col("base").isNull(), F.col("url")).otherwise(resolved(F.col("url"), F.col("base"))))
    wanted = F.filter("tags", lambda t: t.rlike("(?i)^<(?:link|meta).*(?:canonical|refresh)"))
    tags = own.select("url", "base", F.explode(wanted).alias("tag"))
    names, values = names_and_values(F.col("tag"))
    tags = settled(tags, names=names, values=values)
    at = lambda name: attribute(F.col("names"), F.col("values"), name)
    is_link = F.col("tag").rlike("(?i)^<link")
    canonical = F.array_contains(F.split(F.lower(at("rel")), r"\s+"), "canonical")
    after = F.regexp_extract(decoded(F.coalesce(at("content"), F.lit(""))), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1)
    href = F.when(is_link & canonical, decoded(at("href"))).when(~is_link & (F.lower(F.trim(at("http-equiv"))) == "refresh"), after)
    raw = settled(tags, href=F.trim(href)).select("url", "base", "href").where("href <> '' AND NOT startswith(href, '#') AND NOT href RLIKE '^(?i)(?:javascript|data|mailto|about):'")
    return settled(raw, target=resolved(F.col("base"), F.col("href"))).select("url", "target").where(host_of(F.col("target")) != "")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages(page_id, url, html); rules as in ruled().

    A page that a rule fits has that rule's verdict. Any other page takes it from its aliases, the pages and targets that
    redirects(url, target), refresh redirects and canonical links connect with it: allow if an allow rule fits one of them,
    else block if a block rule does, else the default. Null urls, urls without :// and without host have no alias, the first two
    no rule. Repeated rows are judged one by one; other columns of pages stay, except those of the four names, which are replaced.
    """
    edges = links(pages)
    if redirects is not None:
        given = redirects.where("instr(url, '://') > 0 AND instr(target, '://') > 0").select("url", "target")
        edges = edges.unionByName(given.where((host_of(F.col("url")) != "") & (host_of(F.col("target")) != "")))
    nodes = components(edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")), "aliases")
    at = F.concat(F.lit("://"), F.col("node"))
    judged = ruled(nodes.withColumns({"h": host_of(at), "p": path_of(at)}), "h", "p", rules, "r").withColumn("v", F.col("r.verdict"))
    classes = judged.groupBy("component").agg(F.min("v").alias("v")).where("v IS NOT NULL")  # allow sorts before block
    kept = pages.drop("html", "host", "path", "rule", "verdict")
    node, rule, alias = (spare(c, kept.columns) for c in ("_node", "_rule", "_alias"))
    aliases = nodes.join(classes, "component").select(F.col("node").alias(node), F.col("v").alias(alias))
    # Pages that cannot have an alias are spread over all partitions.
    key = F.when(F.col("url").contains("://"), node_of(F.col("url"))).otherwise(F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string")))
    own = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), node: key})
    own = ruled(own, "host", "path", rules, rule).join(aliases, node, "left")
    return own.withColumns({"rule": F.col(rule)["rule"], "verdict": F.coalesce(F.col(rule)["verdict"], alias, F.lit(default))}).drop(rule, node, alias)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '') AS tail
  FROM pages),
rules(rule, h, pre, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
tags AS (SELECT host || tail AS a, page_id, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS site, path, regexp_extract_all(
  regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|textarea|title|noscript|template)\b.*?</(?:script|style|textarea|title|noscript|template)\s*>', ' ', 'g'), '(?i)<(?:link|meta|base)[\s/](?:(?:[^<>"'']|"[^"]*"|''[^'']*'')*>|[^<>]*>)') AS tags
  FROM p WHERE contains(url, '://') AND host <> ''),
each AS (SELECT page_id, a, site, path, i, lower(regexp_extract(tag, '^<(\w+)', 1)) AS element, list_transform(regexp_extract_all(regexp_replace(tag, '^<\w+', ''), '([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 1), lambda x: lower(x)) AS names,
  list_transform(regexp_extract_all(regexp_replace(tag, '^<\w+', ''), '([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?', 2), lambda x: CASE WHEN x[1] IN ('"', '''') THEN substr(x, 2, length(x) - 2) ELSE x END) AS vals FROM (SELECT * EXCLUDE (tags), unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM tags)),
given AS (SELECT *, vals[list_position(names, 'href')] AS href0, vals[list_position(names, 'content')] AS content FROM each),
bases AS (SELECT page_id, arg_min(href0, i) AS b FROM given WHERE element = 'base' AND href0 <> '' GROUP BY page_id),
hrefs AS (SELECT page_id, a, site, path, CASE WHEN element = 'link' AND list_contains(string_split_regex(lower(vals[list_position(names, 'rel')]), '\s+'), 'canonical') THEN href0
  WHEN element = 'meta' AND lower(trim(vals[list_position(names, 'http-equiv')])) = 'refresh' THEN regexp_extract(content, '(?i)\burl\s*=\s*["'']?([^"'']+)', 1) END AS href FROM given),
placed AS (SELECT a, h, CASE WHEN b IS NULL THEN site ELSE regexp_extract(full_base, '^(.*?://[^/?#]*)', 1) END AS site, CASE WHEN b IS NULL THEN path ELSE regexp_extract(full_base, '://[^/?#]*([^?#]*)', 1) END AS path
  FROM (SELECT a, replace(trim(href), '&amp;', '&') AS h, site, path, b, CASE WHEN contains(b, '://') THEN b WHEN starts_with(b, '//') THEN 'http:' || b WHEN starts_with(b, '/') THEN site || b ELSE site || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || b END AS full_base
    FROM hrefs LEFT JOIN bases USING (page_id) WHERE href <> '' AND NOT starts_with(href, '#'))),
absolute AS (SELECT a, CASE WHEN contains(h, '://') THEN h WHEN starts_with(h, '//') THEN 'http:' || h WHEN starts_with(h, '/') THEN site || h
  ELSE site || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || h END AS t FROM placed),
e AS (SELECT DISTINCT a, lower(regexp_extract(t, '://([^/?#]*)', 1)) || regexp_extract(t, '://[^/?#]*([^#]*)', 1) AS b FROM absolute WHERE regexp_extract(t, '://([^/?#]*)', 1) <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
node_verdict AS (SELECT b, arg_max(v, length(rule)) AS v FROM (SELECT DISTINCT b FROM reach) n
  JOIN rules ON (regexp_extract(b, '^([^/?]*)', 1) = h OR ends_with(regexp_extract(b, '^([^/?]*)', 1), '.' || h)) AND starts_with(regexp_extract(b, '^[^/?]*([^?]*)', 1), pre) GROUP BY b),
class_verdict AS (SELECT a, min(v) AS v FROM reach JOIN node_verdict USING (b) GROUP BY a),
own AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, own.rule, coalesce(own.v, c.v, 'allow') AS verdict
FROM p LEFT JOIN own USING (page_id) LEFT JOIN class_verdict c ON c.a = host || tail
"""
