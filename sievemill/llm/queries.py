"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_duplicates
from .language_id import identify, identify_documents, of_pages
from .license_scan import scan_licenses
from .manifest_queries import ORACLES as MANIFEST_ORACLES
from .manifest_queries import QUERIES as MANIFEST_QUERIES
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .shared import read_table
from .token_counts import count_tokens
from .toxicity import classify
from .transport_stream import access_units, media_features, stored_payloads
from .url_filters import Rule, judge_urls

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = r"""
WITH RECURSIVE rules(host, path, own) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), urls AS (
  SELECT DISTINCT url FROM pages
  UNION
  SELECT regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages WHERE html ILIKE '%canonical%'
  UNION
  SELECT regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages WHERE html ILIKE '%http-equiv%'
), parts AS (
  SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
           lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[A-Za-z]+|gclid|fbclid|ref)(=|$)')), '&') AS query
  FROM urls
), named AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS node
  FROM parts
), fits AS (
  SELECT n.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.own, length(r.host || r.path)) AS own
  FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY n.url
), declared AS (
  SELECT p.url, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM pages p WHERE html ILIKE '%canonical%' OR html ILIKE '%http-equiv%'
), edges AS (
  SELECT a.node AS a, b.node AS b FROM declared d JOIN named a ON a.url = d.url JOIN named b ON b.url = d.target WHERE d.target <> '' AND a.node <> b.node
), reach(node, other) AS (
  SELECT a, b FROM (SELECT a, b FROM edges UNION SELECT b, a FROM edges)
  UNION
  SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON r.other = e.a
), grouped AS (
  SELECT n.url, coalesce(least(n.node, min(r.other)), n.node) AS component FROM named n LEFT JOIN reach r ON r.node = n.node GROUP BY n.url, n.node
), heard AS (
  SELECT g.component, bool_or(f.own = 'allow') AS allowed, bool_or(f.own = 'block') AS blocked
  FROM grouped g JOIN fits f ON f.url = g.url WHERE g.component IS NOT NULL AND g.url IN (SELECT url FROM pages) GROUP BY g.component
)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule AS rule,
       coalesce(f.own, CASE WHEN h.allowed THEN 'allow' WHEN h.blocked THEN 'block' END, 'allow') AS verdict
FROM pages p
LEFT JOIN named n ON n.url = p.url
LEFT JOIN fits f ON f.url = p.url
LEFT JOIN grouped g ON g.url = p.url
LEFT JOIN heard h ON h.component = g.component
"""


def _linked_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every page joined to the first of its four by a canonical link, a refresh or a redirect row, and a second page that names it by a relative link."""
    pages = read_table(spark, sf_dir, "pages")
    heads = pages.where("page_id % 4 = 0").selectExpr("page_id AS head", "url AS head_url")
    four = pages.join(heads, F.expr("head = page_id - page_id % 4"), "left")
    mine = four.selectExpr(
        "page_id", "url",
        """concat(CASE page_id % 4 WHEN 1 THEN concat('<link rel=icon href=/i><LINK HREF="', replace(head_url, '&', '&amp;'), '" rel="nofollow Canonical">')
                  WHEN 2 THEN concat('<meta content="0; URL=', head_url, '" http-equiv=Refresh>') ELSE '' END, html) AS html""",
    )
    second = pages.selectExpr(
        "page_id + 10000000 AS page_id", r"concat(regexp_extract(url, '^(.*?://[^/?#]*)', 1), '/alias/', page_id) AS url",
        r"""concat("<link href='../", CASE WHEN page_id % 2 = 0 THEN './' ELSE 'x/../' END, replace(regexp_extract(url, '^.*?://[^/?#]*/?(.*)', 1), '&', '&amp;'), "' rel=canonical>") AS html""",
    )
    return mine.unionByName(second), four.where("page_id % 4 = 3").selectExpr("url AS from_url", "head_url AS to_url")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, redirects = _linked_pages(spark, sf_dir)
    return judge_urls(pages, URL_RULES, redirects)


_start, _rest = OP1_SQL.split("), urls AS (")
_middle = _rest[_rest.index("), parts AS (") : _rest.index("), declared AS (")]
#: The same rules over all linked pages. Which page names which is known here, so no markup is read.
ALIASES_SQL = (
    _start
    + r"""), linked AS (
  SELECT page_id, url FROM pages
  UNION ALL
  SELECT page_id + 10000000, regexp_extract(url, '^(.*?://[^/?#]*)', 1) || '/alias/' || page_id FROM pages
), urls AS (
  SELECT DISTINCT url FROM linked
"""
    + _middle
    + """), declared AS (
  SELECT p.url, h.url AS target FROM pages p JOIN pages h ON h.page_id = p.page_id - p.page_id % 4
  UNION
  SELECT a.url, p.url FROM linked a JOIN pages p ON a.page_id = p.page_id + 10000000
"""
    + _rest[_rest.index("), edges AS (") :].replace("FROM pages", "FROM linked")
)


def media_access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary packets of all stored texts, with their time stamps and random-access points."""
    units = access_units(stored_payloads(read_table(spark, sf_dir, "documents")), "doc_id", "media")
    return units.select(F.col("id").alias("doc_id"), "unit", "pts", "random_access", F.length("data").cast("long").alias("bytes"))


UNITS_SQL = """
WITH sizes AS (
  SELECT doc_id, greatest(64, (strlen(coalesce(text, '')) + 63) // 64 * 64) AS n FROM documents
), units AS (
  SELECT doc_id, n, unnest(range(0, (n + 16383) // 16384)) AS unit FROM sizes
)
SELECT doc_id, unit, unit * 3600 AS pts, unit % 4 = 0 AS random_access, least(16384, n - unit * 16384) AS bytes FROM units
"""


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stored_payloads(read_table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read_table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(of_pages(read_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), ''))[1:15])::BIGINT AS h
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per
), weighed AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM ranked
), levelled AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT arg_min(level, [ratio, rank]) AS final FROM levelled WHERE ratio > level
), targets AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), final * weight), CAST(cap AS DOUBLE)) AS target
  FROM levelled CROSS JOIN final
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets
), cells AS (
  SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h
), summed AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM cells
), picked AS (
  SELECT s.source, s.h,
         (s.upto <= t.target - t.passes * t.source_size)
         OR (s.upto - s.words < t.target - t.passes * t.source_size
             AND t.target - t.passes * t.source_size - (s.upto - s.words) >= s.words - (t.target - t.passes * t.source_size - (s.upto - s.words))) AS more
  FROM summed s JOIN split t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST((t.passes + CAST(p.more AND t.target > t.passes * t.source_size AS INT)) * d.size AS BIGINT) AS taken
FROM sized d
JOIN split t ON d.source IS NOT DISTINCT FROM t.source
JOIN picked p ON d.source IS NOT DISTINCT FROM p.source AND d.h = p.h
"""


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and all that each document reaches: for small tables.
OP9_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({NORM}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least_of AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""

OP10_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {NORM} AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "url_aliases": url_aliases,
    "media_access_units": media_access_units,
    "op2_transport_streams": op2_transport_streams,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
} | MANIFEST_QUERIES
ORACLES: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "url_aliases": ALIASES_SQL,
    "media_access_units": UNITS_SQL,
    "op6_source_mixing": OP6_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
} | MANIFEST_ORACLES
