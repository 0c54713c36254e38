"""URL filters with redirect equivalence.

Rules decide the URLs they fit. URLs that are one page under several names decide for each other:
aliases are found as connected components over redirect and canonical-link edges, and a component
hands its block to members that no rule fits, unless one of its members is explicitly allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import TAG, attribute
from .components import connected_components
from .shared import join_keyed, lower_az, stored


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: Rules up to this many are part of the plan; more are joined by host suffix.
INLINE_RULES = 64
#: Rules up to which their table goes to every task.
BROADCAST_RULES = 1_000_000
#: Query fields that only say where a reader came from.
TRACKING = r"^(utm_[A-Za-z]+|gclid|fbclid|ref)(=|$)"
#: Target of a refresh, in the content of its tag.
REFRESH_URL = r"(?i)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"'\s>]+)"


def url_host(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """The name under which a URL's plain aliases meet: without scheme, fragment, tracking fields and a last slash."""
    fields = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda f: (f != "") & ~f.rlike(TRACKING))
    query = F.array_join(fields, "&")
    node = F.concat(url_host(url), F.regexp_replace(url_path(url), r"/+\z", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url_host(url) != "", node)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken."""
    parts = F.split(path, "/")
    size = F.size(parts)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(size - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(base: Column, target: Column) -> Column:
    """A link's target as a whole URL, seen from the page at ``base``; character references of & are read.

    Null for targets of other schemes (mailto and the like), for places on the page itself, and where
    the base has no "://".
    """
    target = F.regexp_replace(F.trim(target), "(?i)&(amp|#38|#x26);", "&")
    scheme = F.regexp_extract(base, r"(?s)^(.*?):\/\/", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?:\/\/[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(url_path(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when((target == "") | target.startswith("#") | (root == ""), F.lit(None).cast("string"))
        .when(target.rlike("(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("?"), F.concat(root, url_path(base), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def declared_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between names, from all canonical links and refresh redirects in the pages' markup.

    Attributes may stand in any order and quoting; a link is canonical if one of its relations is.
    """
    found = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")).where(F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = [F.regexp_extract_all("html", F.lit(TAG.format(t)), F.lit(0)) for t in ("link", "meta")]
    links = F.filter(tags[0], lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    refreshes = F.filter(tags[1], lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    targets = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(refreshes, lambda t: F.regexp_extract(attribute(t, "content"), REFRESH_URL, 1)))
    to = found.select("url", F.explode(targets).alias("to"))
    return to.select(url_node(F.col("url")).alias("a"), url_node(resolved(F.col("url"), F.col("to"))).alias("b")).where("a <> b")


def _rule_columns(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` and ``own``: the longest fitting rule's name and verdict; of equals, one that allows."""
    best = "struct<size:int,allows:int,rule:string,own:string>"
    ranked = [(r, F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(int(r.verdict == "allow")).alias("allows"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("own"))) for r in rules]
    if len(rules) <= INLINE_RULES:
        fits = [F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path) & (F.col("host") != ""), s) for r, s in ranked]
        return rows.withColumn("best", F.array_max(F.array(*fits)) if fits else F.lit(None).cast(best)).select(*rows.columns, "best.rule", "best.own")
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.host, r.path, len(r.host + r.path), int(r.verdict == "allow"), r.host + r.path, r.verdict) for r in rules], "suffix string, start string, size int, allows int, rule string, own string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    urls = stored(rows.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    # A suffix such as com has a share of all URLs; the rules, a list of the driver's, go to every task.
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    fitting = urls.withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    chosen = fitting.groupBy("host", "path").agg(F.max(F.struct("size", "allows", "rule", "own")).alias("best"), F.max("n").alias("n"))
    total = urls.agg(F.sum("n")).first()[0] or 0
    return join_keyed(rows, chosen, ["host", "path"], "n", total, "left").select(*rows.columns, "best.rule", "best.own")


def judge_urls(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", default: str = "allow"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every URL, one row per row.

    A rule fits its host and all subdomains if the path starts with its path; the longest fitting rule
    (host and path together) decides, and of two equally long ones the one that allows. A URL that no
    rule fits takes allow if a rule allows one of its aliases, else block if a rule blocks one, else
    ``default``. Aliases are the URLs of one name (`url_node`) and names joined by canonical links and
    refreshes in ``html_col``, read as `declared_edges` does, or by rows (from_url, to_url) of ``redirects``. A null URL, or one without
    "://", has empty host and path, fits no rule and has no alias. Repeated rows and null ids pass
    through; other columns play no part. An empty table gives an empty one.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), url_node(url).alias("node"))
    rows = stored(_rule_columns(rows, rules), "judged")
    total = rows.count()

    edges = [declared_edges(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        edges.append(redirects.select(url_node(F.col("from_url")).alias("a"), url_node(F.col("to_url")).alias("b")).where("a <> b"))
    joined = rows
    if edges:
        every = stored(edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1]), "aliases")
        if not every.isEmpty():
            sized = connected_components(every).join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
            joined = join_keyed(rows, stored(sized, "components"), "node", "n", total, "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    # Only groups with both a decision to hand on and a URL without one go back to the pages.
    heard = joined.where("node IS NOT NULL").groupBy("node").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own").isNull()).alias("open"), F.count(F.lit(1)).alias("n")
    )
    heard = heard.where("open AND (allowed OR blocked)").select("node", "n", F.when(F.col("allowed"), F.lit("allow")).otherwise(F.lit("block")).alias("heard"))
    # A name with very many pages, under tracking parameters or in a large component, meets its verdict by broadcast.
    return join_keyed(joined, stored(heard, "heard"), "node", "n", total, "left").select("page_id", "host", "path", "rule", F.coalesce("own", "heard", F.lit(default)).alias("verdict"))
