"""Verification of fetched files by their text, never by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import IDEOGRAPHS, doi, keywords, tokens
from ..sources.tables import spread
from ..storage import stored

#: Titles of one or two words that are searched in one pass; so many come to the driver at a time.
SHORT_BLOCK = 20_000
#: Longer titles that go to every task at a time, and texts whose words are counted to tell rare ones.
ANCHOR_BLOCK, COUNTED_TEXTS = 50_000, 5_000


def verify(files: DataFrame, studies: DataFrame, least: float = 0.6) -> DataFrame:
    """``path, study_id, doi_ok, author_ok, title_share, verdict`` for each fetched file.

    files: ``path, study_id, text``; studies: ``study_id, doi, author, title``, one row a study. The
    three kinds of evidence stay visible. Verdict (an assumption): verified if the text's DOI is the
    study's, or the text shows none and has the author and at least ``least`` of the title keywords;
    mismatch if its DOI is another; unverified otherwise, and for an empty text or an unknown study.
    """
    wanted = studies.select("study_id", F.lit(True).alias("known"), F.lower("doi").alias("doi"), F.lower("author").alias("author"), keywords(F.col("title")).alias("keys"))
    rows = files.join(wanted, "study_id", "left").withColumn("seen", doi(F.col("text"))).withColumn("words", tokens(F.col("text")))
    share = F.when(F.size("keys") > 0, F.size(F.array_intersect("keys", "words")) / F.size("keys")).otherwise(F.lit(0.0))
    # A name in a script without spaces is no word of its own.
    named = F.when(F.col("author").rlike(f"[{IDEOGRAPHS}]"), F.lower("text").contains(F.col("author"))).otherwise(F.array_contains("words", F.col("author")))
    rows = rows.select("path", "study_id", "known", "seen", (F.col("seen").eqNullSafe(F.col("doi")) & F.col("seen").isNotNull()).alias("doi_ok"), F.coalesce(named, F.lit(False)).alias("author_ok"), F.round(share, 4).alias("title_share"))
    verdict = F.when(F.col("known").isNull(), "unverified").when(F.col("doi_ok"), "verified").when(F.col("seen").isNotNull(), "mismatch").when(F.col("author_ok") & (F.col("title_share") >= least), "verified").otherwise("unverified")
    return rows.withColumn("verdict", verdict).drop("seen", "known")


def _holding(texts: DataFrame, titles: list[str]) -> DataFrame:
    """(doc_id, title) of the texts that hold one of these titles, by an automaton over all of them at once."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for title in titles:
            automaton.add_word(title, title)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for title in {t for _, t in automaton.iter(text or "")}:
                    ids.append(doc)
                    found.append(title)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string())], ["doc_id", "title"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, title string")


def _word_counts(texts: DataFrame) -> DataFrame:
    """``anchor, texts``: how many of about `COUNTED_TEXTS` texts have a word. Only a guide to which words are rare."""
    share = min(1.0, COUNTED_TEXTS / max(texts.count(), 1))
    some = texts if share == 1 else texts.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 20)) < int(share * (1 << 20)))
    return some.select(F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("texts"))


def texts_with_titles(texts: DataFrame, titles: DataFrame, block: int = SHORT_BLOCK) -> DataFrame:
    """(doc_id, item_id) of the texts that hold a title word for word.

    texts: ``doc_id, text``; titles: ``item_id, title``. An inner word of a title of three words or more
    must be a word of the text: the one that is rarest in a sample of texts makes an equality join, with
    about `ANCHOR_BLOCK` titles at a time, and the few pairs that share it are then searched. Shorter titles have no inner word: they are searched as a set of queries, about
    ``block`` at a time, each block in one pass over all texts. Null and empty titles are found nowhere;
    a title may begin and end inside a word.
    """
    words = F.split("title", "[ \n]")
    rows = stored(titles.where("title <> ''").select("item_id", "title", words.alias("words")), "titles")
    texts = spread(texts.select("doc_id", "text"))
    inner = rows.where(F.size("words") > 2).select("item_id", "title", F.explode(F.array_distinct(F.slice("words", 2, F.size("words") - 2))).alias("anchor"))
    counted = _word_counts(texts)
    rarest = inner.join(counted, "anchor", "left").groupBy("item_id", "title").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)), -F.length("anchor"), F.col("anchor").alias("anchor"))).alias("least"))
    anchored = stored(rarest.select("item_id", "title", "least.anchor"), "anchors")
    of_text, found = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("anchor")), None
    blocks = max(1, -(-anchored.count() // ANCHOR_BLOCK))
    for k in range(blocks):
        # Titles go to every task, so an anchor that many texts have stays spread as the texts are.
        side = F.broadcast(anchored.where(F.pmod(F.xxhash64("title"), F.lit(blocks)) == k) if blocks > 1 else anchored)
        pairs = of_text.join(side, "anchor").select("doc_id", "item_id", "title")
        part = pairs.join(texts, "doc_id").where(F.col("text").contains(F.col("title"))).select("doc_id", "item_id")
        found = part if found is None else found.unionByName(part)
    short = rows.where(F.size("words") <= 2).select("item_id", "title")
    blocks = -(-short.count() // block)
    for k in range(blocks):
        asked = short.where(F.pmod(F.xxhash64("title"), F.lit(blocks)) == k)
        wanted = [r["title"] for r in asked.select("title").distinct().collect()]
        if wanted:
            found = found.unionByName(_holding(texts, wanted).join(asked, "title").select("doc_id", "item_id"))
    return found.distinct()
