"""Grounded answers: search in notes, and answer only from notes that exist."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..sources.tables import spread
from ..storage import stored
from ..tasks import arrow_map

INSUFFICIENT = "insufficient_evidence"
#: Question words that go to every task at a time; more are asked in blocks, a pass over the notes each.
BROADCAST_ROWS = 200_000
#: Words of notes that meet words of questions at a time inside a task.
MEETINGS = 2_000_000


def notes_from_documents(docs: DataFrame) -> DataFrame:
    """A note for each line: ``note_id, source_id, category, text``."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.select(F.concat_ws("-", "doc_id", "line_no").alias("note_id"), F.col("doc_id").alias("source_id"), F.col("source").alias("category"), "text").where("text <> ''")


def _postings(asked: pa.Table) -> tuple:
    """Question words with the questions that have them, as arrays: words, where each word's entries begin, and each entry's question and category (-1: any)."""
    import pyarrow.compute as pc

    asked = asked.sort_by("word").combine_chunks()
    ids, categories, words = (asked[c].combine_chunks().dictionary_encode(null_encoding=how) for c, how in (("question_id", "encode"), ("in_category", "mask"), ("word", "mask")))
    begins = np.searchsorted(words.indices.to_numpy(), np.arange(len(words.dictionary) + 1))
    return words.dictionary, begins, ids.dictionary, ids.indices.to_numpy(), categories.dictionary, pc.fill_null(categories.indices, -1).to_numpy()


def _row_hits(held, top: int | None, least: int):
    """Shared keywords of each note's row and each question, told inside the row.

    A row whose note stands in no other gives its final count: of those the ones under ``least`` go, and with
    ``top`` those that so many others of the batch surpass.
    """

    def met(some: slice, rows: np.ndarray, found: np.ndarray, category: np.ndarray, again: np.ndarray) -> tuple:
        _, begins, ids, question, _, wanted = held.value
        rows, found = rows[some], found[some]
        times = begins[found + 1] - begins[found]
        entry = np.repeat(begins[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        row = np.repeat(rows, times)
        entry, row = (x[(wanted[entry] < 0) | (wanted[entry] == category[row])] for x in (entry, row))
        both, hits = np.unique(row.astype(np.int64) * len(ids) + question[entry], return_counts=True)
        row, asked = both // max(len(ids), 1), both % max(len(ids), 1)
        enough = hits >= least
        if top is not None:
            order = np.lexsort((-hits, again[row], asked))
            first = np.flatnonzero(np.diff(asked[order], prepend=-1))
            last = np.minimum(first + top, np.append(first[1:], len(order))) - 1
            bound = np.zeros(len(ids), np.int64)
            bound[asked[order][first]] = hits[order][last]
            full = np.zeros(len(ids), bool)
            full[asked[order][first]] = (last - first == top - 1) & ~again[row][order][last]
            enough &= ~full[asked] | (hits >= bound[asked])
        keep = enough | again[row]
        return row[keep], asked[keep], hits[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        words, begins, ids, _, categories, _ = held.value
        for batch in batches:
            found = pc.index_in(batch.column(3).flatten(), value_set=words)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            rows = pc.list_parent_indices(batch.column(3)).to_numpy()[known]
            found = found.drop_null().to_numpy()
            category = pc.fill_null(pc.index_in(batch.column(1), value_set=categories, skip_nulls=True), -2).to_numpy()
            again = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            part = np.cumsum(begins[found + 1] - begins[found]) // MEETINGS
            # A part begins with a row.
            edges = np.unique(np.searchsorted(rows, rows[np.flatnonzero(np.diff(part, prepend=-1))])) if len(rows) else np.zeros(0, np.int64)
            for low, high in zip(edges, np.append(edges[1:], len(rows))):
                row, asked, hits = met(slice(low, high), rows, found, category, again)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked)), batch.column(0).take(pa.array(row)), pa.array(hits, pa.int64()), pa.array(again[row])], ["question_id", "note_id", "hits", "again"])

    return run


def _hits(notes: DataFrame, questions: DataFrame, top: int | None, least: int) -> DataFrame:
    spark = notes.sparkSession
    asked = stored(questions.select("question_id", F.col("category").cast("string").alias("in_category"), F.explode(keywords(F.col("text"))).alias("word")), "asked")
    name = F.xxhash64("note_id").alias("name")
    repeated = stored(notes.select(name).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(True).alias("again")), "repeated")
    rows = spread(notes.select("note_id", "category", "text"))
    if repeated.isEmpty():
        rows = rows.withColumn("again", F.lit(False))
    else:
        rows = rows.withColumn("name", name).join(repeated, "name", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    words = rows.select("note_id", F.col("category").cast("string").alias("category"), "again", keywords(F.col("text")).alias("words"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "question_id"), (words, "note_id"))]
    blocks, found = max(1, -(-asked.count() // BROADCAST_ROWS)), None
    for k in range(blocks):
        side = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == k) if blocks > 1 else asked
        part = arrow_map(words, _row_hits(spark.sparkContext.broadcast(_postings(side.toArrow())), top, least), f"question_id {kinds[0]}, note_id {kinds[1]}, hits long, again boolean")
        found = part if found is None else found.unionByName(part)
    counts = found.select("question_id", "note_id", "hits")
    if repeated.isEmpty():
        return counts
    return counts.groupBy("question_id", "note_id").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= least)


def shared_keywords(notes: DataFrame, questions: DataFrame, least: int = 1) -> DataFrame:
    """``question_id, note_id, hits``: every note that shares at least ``least`` keywords with a question.

    questions: ``question_id, category, text``; a question with a category is searched in that category
    only. Notes' words meet the questions' words, about `BROADCAST_ROWS` of them at a time, by broadcast, so
    a frequent word stays spread as the notes are; they are counted inside each note's row, and nothing is
    shuffled but the counts of notes that stand in several rows. Rows that repeat a note_id
    count together. Notes and questions without keywords find nothing.
    """
    return _hits(notes, questions, None, least)


def search(notes: DataFrame, questions: DataFrame, top: int = 5, least: int = 1) -> DataFrame:
    """``question_id, note_id, hits, rank``: the ``top`` notes of `shared_keywords` for each question; ties go to the smaller note_id."""
    order = Window.partitionBy("question_id").orderBy(F.col("hits").desc(), "note_id")
    return _hits(notes, questions, top, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def grounded_answers(questions: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """``question_id, verdict, citations``: the notes an answer may rest on, best first.

    A note counts as evidence from ``least`` shared keywords on (an assumption). A question without one
    says that its evidence is insufficient, and cites nothing.
    """
    evidence = found.where(F.col("hits") >= least).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "note_id"))).alias("cited"))
    rows = questions.select("question_id").join(evidence, "question_id", "left")
    verdict = F.when(F.col("cited").isNull(), INSUFFICIENT).otherwise("answered")
    return rows.select("question_id", verdict.alias("verdict"), F.coalesce(F.transform("cited", lambda c: c["note_id"]), F.array().cast("array<string>")).alias("citations"))


def invented_citations(answers: DataFrame, notes: DataFrame) -> DataFrame:
    """Cited notes that don't exist: ``question_id, note_id``. Must be empty."""
    cited = answers.select("question_id", F.explode("citations").alias("note_id"))
    return cited.join(notes.select("note_id"), "note_id", "left_anti").select("question_id", "note_id")


def survey(answers: DataFrame, notes: DataFrame) -> DataFrame:
    """Material of a survey from the notes that answers cite, see `survey_of`."""
    return survey_of(answers.select("question_id", F.explode("citations").alias("note_id")), notes)


def survey_of(evidence: DataFrame, notes: DataFrame) -> DataFrame:
    """``question_id, source_id, notes``: the sources of each question's notes, and how many notes each gives. evidence: ``question_id, note_id``."""
    cited = evidence.select("question_id", "note_id").join(notes.select("note_id", "source_id"), "note_id")
    return cited.groupBy("question_id", "source_id").agg(F.count(F.lit(1)).alias("notes"))
