"""Queries of the operators on manifests, web pages and conversations, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .main_text import main_texts
from .merkle import verified_documents
from .prefix_trie import conversation_trie
from .shared import read_table

#: DuckDB has no crc32: the usual table of 256 remainders, as a list.
CRC = """crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32_sql(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits; `CRC` must be among the tables."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(read_table(spark, sf_dir, "documents"))


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, leaves: str, levels: int) -> str:
    """Tables name0, name1, ... of nodes (g, idx, h, n), each from the one before, and the nodes that remain."""
    made = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        made.append(f"{name}{k + 1} AS (SELECT g, idx // 16 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, n FROM {name}{k} WHERE n > {16**k} GROUP BY g, idx // 16, n)")
    last = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n <= {16**k}" + (f" AND n > {16 ** (k - 1)}" if k else "") for k in range(levels + 1))
    return ", ".join([*made, f"{name}_last AS ({last})"])


def _folds(name: str, tree: str, first: str, levels: int) -> str:
    """Tables that carry (row, g, idx, cur, proof) up a tree."""
    made, last = [], first
    for k in range(levels):
        made.append(f"""{name}{k} AS (
  SELECT f.row, f.g, f.idx // 16 AS idx, f.n, sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.cur ELSE m.h END, '' ORDER BY m.idx)) AS cur,
         f.proof || coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (m.idx <> f.idx), '') AS proof
  FROM {last} f JOIN {tree}{k} m ON m.g = f.g AND m.idx // 16 = f.idx // 16 WHERE f.n > {16**k} GROUP BY f.row, f.g, f.idx, f.n, f.cur, f.proof
  UNION ALL SELECT row, g, idx // 16, n, cur, proof FROM {last} WHERE n <= {16**k})""")
        last = f"{name}{k}"
    return ", ".join(made)


LEVELS, TOP_LEVELS = 5, 4
OP11_SQL = f"""
WITH {CRC}, leaves AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {crc32_sql('doc_id')} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc
), groups AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)
), rows AS (
  SELECT doc_id, leaf, other, g, row_number() OVER (ORDER BY doc_id) AS row,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n
  FROM leaves l JOIN groups s ON l.source IS NOT DISTINCT FROM s.source
), {_tree('n', 'SELECT g, idx, leaf AS h, n FROM rows', LEVELS)},
{_tree('t', 'SELECT 0 AS g, g AS idx, h, count(*) OVER () AS n FROM n_last', TOP_LEVELS)},
start AS (SELECT row, g, idx, n, coalesce(other, leaf) AS cur, '' AS proof FROM rows),
{_folds('f', 'n', 'start', LEVELS)},
start_top AS (SELECT f.row, 0 AS g, f.g AS idx, (SELECT count(*) FROM n_last) AS n, f.cur, f.proof FROM f{LEVELS - 1} f),
{_folds('u', 't', 'start_top', TOP_LEVELS)}
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.cur AS folded_root, u.cur = t.h AS verified
FROM rows r JOIN n_last s ON s.g = r.g JOIN u{TOP_LEVELS - 1} u ON u.row = r.row CROSS JOIN t_last t
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH {CRC}, turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS size, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k
  FROM (SELECT *, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, {crc32_sql('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
  SELECT c.conv_id, t.k, t.id, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k, t.id, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS d, size, string_agg(id, '') OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT path, d, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n FROM paths GROUP BY path, d
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE d = last GROUP BY path
), kids AS (
  SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT a.path, sum((m.n - 1) * m.size) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes m LEFT JOIN kids k ON k.path = m.path JOIN paths a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.path
)
SELECT m.conv_id, m.d AS depth, CASE WHEN m.d > 0 THEN u.conv_id END AS parent_conv_id, m.n AS n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes m JOIN below b ON b.path = m.path LEFT JOIN kids k ON k.path = m.path LEFT JOIN ends e ON e.path = m.path
LEFT JOIN nodes u ON u.d = m.d - 1 AND u.path = left(m.path, 32 * (m.d - 1))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_extraction": op12_html_extraction,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES: dict[str, str] = {
    "op11_merkle_manifest": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
