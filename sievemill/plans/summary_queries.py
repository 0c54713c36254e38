"""Approximate totals over cases, from sketches of every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.summaries import KEPT_ITEMS, Summaries
from ..sources.tables import read_table
from ..storage import fresh_path


def _stored(spark: SparkSession, sf_dir: str) -> Summaries:
    events = read_table(spark, sf_dir, "events").selectExpr("user_id % 5 AS case_no", "event_type AS `group`", "event_id div 3 AS member", "value", "concat(event_type, ' ', user_id) AS item")
    kept = Summaries(spark, fresh_path(spark, "summaries"))
    for k in range(5):
        kept.add(f"case{k}", events.where(f"case_no = {k}"))
    return kept


def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).report()


def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).frequent()


#: Estimates; the tests hold them within their stated errors of exact SQL.
QUERIES = {"case_summaries": case_summaries, "frequent_items": frequent_items}
#: The operator's own rule: of each case and group the items of the most rows are kept with their number, and what one left out may have at most is known.
ORACLES = {
    "frequent_items": f"""
WITH counted AS (
  SELECT user_id % 5 AS case_no, event_type AS grp, event_type || ' ' || user_id AS item, count(*) AS n FROM events
  WHERE user_id % 5 BETWEEN 0 AND 4 AND event_type IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_no, grp ORDER BY n DESC, item) AS rank FROM counted
), cuts AS (
  SELECT case_no, grp, n AS cut FROM ranked WHERE rank = {KEPT_ITEMS + 1}
), kept AS (
  SELECT item, CAST(sum(n) AS BIGINT) AS at_least, CAST(sum(n) + (SELECT coalesce(sum(cut), 0) FROM cuts) - sum(coalesce(cut, 0)) AS BIGINT) AS at_most
  FROM ranked LEFT JOIN cuts USING (case_no, grp) WHERE rank <= {KEPT_ITEMS} GROUP BY item
)
SELECT item, at_least, at_most, CAST(row_number() OVER (ORDER BY at_least DESC, item) AS INTEGER) AS rank FROM kept ORDER BY at_least DESC, item LIMIT 10
""",
}
