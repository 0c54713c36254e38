"""A stored index of the terms of notes, in any script, extended by appending and ranked by BM25."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.term_counts import counted
from ..joins import join_keyed
from ..sources.tables import spread
from ..storage import stored
from ..tasks import arrow_map
from ..versions import Versions

#: Terms of a note, and how often each is there.
FOUND = "found array<struct<term:string,times:bigint>>"
#: How much a repeated term and a note's length count.
K1, B = 1.2, 0.75
#: Terms of questions that go to every task; more are asked in blocks, one pass over the postings each.
ASKED_TERMS = 200_000
#: Ids that are appended again up to which they go to every task.
KNOWN_IDS = 1_000_000
#: Bytes of text whose terms are counted at once; notes, cells of a table of these by terms, and questions that are scored at once.
TEXT_BYTES, SCORED_NOTES, SCORED_CELLS, SCORED_QUESTIONS = 2_000_000, 2_000, 1_000_000, 512


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of an id, a category and a lower-cased text: each text's length and different terms."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            of, term, times = counted(part.column(2).to_pylist())
            length = np.bincount(of, times, part.num_rows).astype(np.int64)
            ends = np.cumsum(np.bincount(of, minlength=part.num_rows))
            found = pa.StructArray.from_arrays([term, pa.array(times, pa.int64())], ["term", "times"])
            found = pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(length), found], [*batch.schema.names[:2], "length", "found"])


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """``key, category, length, found`` of rows of a key, a category and a text; found: each different term of the text, and how often it is there."""
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, "category")]
    texts = rows.select(key, "category", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return arrow_map(texts, _counts, f"{key} {kinds[0]}, category {kinds[1]}, length long, {FOUND}")


def _scores(held, mean: float, top: int):
    """Scores of the notes of a task that may be among a question's best. held: see `_asked`."""

    def scored(asked: dict, ids: pa.Array, category: pa.Array, note: np.ndarray, local: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        """local: numbers of terms among those these notes have; ``asked["numbers"]`` gives them by the numbers of all asked."""
        import pyarrow.compute as pc

        n, width = len(ids), int(local.max()) + 1
        table = np.bincount(note * width + local, weight, n * width).reshape(n, width)
        order = np.empty(n, np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        for low, high in asked["slices"]:
            first, last = asked["questions"][low], asked["questions"][high]
            rows = slice(asked["pairs"][first], asked["pairs"][last])
            at = asked["numbers"][asked["term"][rows]]
            there = at >= 0
            want = np.zeros((width, last - first))
            want[at[there], asked["pair"][rows][there] - first] = asked["idf"][rows][there]
            score = table @ want
            for k in range(first, last):
                if asked["category"][k] is not None:
                    score[~pc.fill_null(pc.equal(category, asked["category"][k]), False).to_numpy(zero_copy_only=False), k - first] = 0
            if high - low < last - first:
                score = np.add.reduceat(score, asked["questions"][low:high] - first, axis=1)
            values = np.where(score > 0, np.floor(score * 1e6 + 0.5) / 1e6, -1)
            bars = asked["bars"][low:high]
            if n >= top:
                np.maximum(bars, np.partition(values, n - top, axis=0)[n - top], out=bars)
            of, question = np.nonzero((values >= 0) & (values >= bars))
            # Of equal scores the smaller ids.
            ranked = np.lexsort((order[of], -values[of, question], question))
            among = question[ranked]
            ranked = ranked[np.arange(len(ranked)) - np.searchsorted(among, among) < top]
            of, question = of[ranked], question[ranked]
            yield pa.RecordBatch.from_arrays([asked["ids"].take(pa.array(question + low)), ids.take(pa.array(of)), pa.array(values[of, question])], ["question_id", "note_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        # bars: the lowest scores with which a note of this task can still be among the best.
        asked = held.value | {"numbers": np.full(len(held.value["terms"]), -1, np.int64), "bars": np.full(len(held.value["ids"]), -1.0)}
        for part in (batch.slice(at, SCORED_NOTES) for batch in batches for at in range(0, batch.num_rows, SCORED_NOTES)):
            ids, category, length, found = part.columns
            sizes = found.value_lengths().to_numpy(zero_copy_only=False)
            terms, times = found.flatten().flatten()
            term = pc.fill_null(pc.index_in(terms, value_set=asked["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = np.flatnonzero(term >= 0)
            note, term, times = np.repeat(np.arange(len(ids)), sizes)[kept], term[kept], times.to_numpy()[kept].astype(np.float64)
            weight = times * (K1 + 1) / (times + K1 * (1 - B + B * length.to_numpy()[note] / mean))
            left = [(0, len(ids))]
            while left:
                a, b = left.pop()
                rows = slice(*np.searchsorted(note, [a, b]))
                own = np.unique(term[rows])
                if (b - a) * len(own) > SCORED_CELLS and b - a > 1:
                    left += [((a + b) // 2, b), (a, (a + b) // 2)]
                elif len(own):
                    asked["numbers"][own] = np.arange(len(own))
                    yield from scored(asked, ids.slice(a, b - a), category.slice(a, b - a), note[rows] - a, asked["numbers"][term[rows]], weight[rows])
                    asked["numbers"][own] = -1

    return run


def _asked(rows: pa.Table) -> dict:
    """Terms of questions, sorted by question and category: numbers of terms and pairs of both by row, where each pair's rows and each question's pairs begin, and the questions that are scored at once."""
    import pyarrow.compute as pc

    coded = [rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("question_id", "in_category", "term")]
    question, category, term = (c.indices.to_numpy().astype(np.int64) for c in coded)
    order = np.lexsort((category, question))
    question, category, term = question[order], category[order], term[order]
    new = np.diff(question, prepend=-1) != 0
    new_pair = new | (np.diff(category, prepend=-1) != 0)
    pairs, questions = np.flatnonzero(new_pair), np.flatnonzero(new[new_pair])
    ends = np.append(questions, len(pairs))
    slices, low = [], 0
    for high in range(1, len(questions) + 1):
        if high == len(questions) or ends[high + 1] - ends[low] > SCORED_QUESTIONS:
            slices.append((low, high))
            low = high
    categories = coded[1].dictionary.to_pylist()
    return {
        "ids": coded[0].dictionary, "terms": coded[2].dictionary, "term": term, "pair": np.cumsum(new_pair) - 1, "idf": pc.take(rows.column("idf"), pa.array(order)).to_numpy(),
        "pairs": np.append(pairs, len(question)), "questions": ends, "category": [categories[c] for c in category[pairs]], "slices": slices,
    }


class NoteIndex:
    """Notes (``note_id, category, text``) and their terms below a folder.

    Every append is a segment of its own and reads only what it adds: the notes with their lengths and all their
    terms, postings (term, note, how often, the note's length and category), and by term the number of notes that have it.
    Statistics of all segments are summed when a question is asked, so a note is found as soon as its
    segment is committed. Rows with a null id aren't indexed; rows that share an id are one note, and an id
    the index has already is left out, so an append that is repeated adds nothing. Texts are whole.
    Segments stay as they were written; a segment that a broken run began is in no version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def _tables(self, part: str, version: int | None = None) -> DataFrame | None:
        folders = [f"{folder}/{part}" for folder in self.versions.entries(version).values()]
        return self.spark.read.parquet(*folders) if folders else None

    def append(self, notes: DataFrame) -> int:
        """Index the notes that aren't in yet; the version that has them."""
        version = self.versions.latest()
        rows = spread(notes.where("note_id IS NOT NULL").select("note_id", "category", "text"))
        known = self._tables("notes")
        if known is not None:
            again = stored(known.select("note_id").join(rows.select("note_id"), "note_id", "left_semi"), "again")
            rows = rows.join(F.broadcast(again) if again.count() <= KNOWN_IDS else again, "note_id", "left_anti")
        folder = self.versions.fresh()
        ids = stored(rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("rows"), F.min("category").alias("category")), "ids")
        # Terms of a note that is one row are counted where it is, without a shuffle; only notes of several rows have to meet.
        whole, several = _counted(rows, "note_id"), ids.where("rows > 1")
        if several.head(1):
            marked = several.select("note_id", "rows", F.lit(True).alias("meets"))
            parts = stored(join_keyed(whole, marked, "note_id", "rows", ids.agg(F.sum("rows")).first()[0], "left"), "parts")
            terms = parts.where("meets").select("note_id", F.inline("found")).groupBy("note_id", "term").agg(F.sum("times").alias("times"))
            terms = terms.groupBy("note_id").agg(F.sum("times").alias("length"), F.collect_list(F.struct("term", "times")).alias("found"))
            met = several.select("note_id", "category").join(terms, "note_id", "left")
            met = met.select("note_id", "category", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("found", F.array().cast(whole.schema["found"].dataType)).alias("found"))
            whole = parts.where("meets IS NULL").drop("meets").unionByName(met)
        whole.write.parquet(f"{folder}/notes")
        written = self.spark.read.schema(whole.schema).parquet(f"{folder}/notes")
        written.select("note_id", "length", "category", F.inline("found")).write.parquet(f"{folder}/postings")
        self.spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("notes")).write.parquet(f"{folder}/terms")
        entries = self.versions.entries(version)
        return self.versions.commit({**entries, f"segment-{len(entries):06d}": folder}, version)

    def search(self, questions: DataFrame, top: int = 5, version: int | None = None) -> DataFrame:
        """``question_id, note_id, score, rank``: the best notes by BM25, ties to the smaller note_id; scores to six places.

        questions: ``question_id, category, text``; one with a category is searched there only. The
        distinct terms of the questions go to every task, in blocks of a bounded number. A task scores its
        notes for all questions at once and passes on the best.
        """
        kinds = questions.schema["question_id"].dataType.simpleString(), self._kind(version)
        schema = f"question_id {kinds[0]}, note_id {kinds[1]}, score double"
        asked = _counted(questions, "question_id").select("question_id", F.col("category").alias("in_category"), F.inline("found")).drop("times").distinct()
        asked = stored(asked, "asked")
        n = asked.count()
        notes = self._tables("notes", version)
        if notes is None or not n:
            return self.spark.createDataFrame([], f"{schema}, rank int")
        count, total = notes.agg(F.count(F.lit(1)), F.sum("length")).first()
        mean = max(total, 1) / count
        frequency = self._tables("terms", version).groupBy("term").agg(F.sum("notes").alias("notes"))
        idf = F.log(1 + (count - F.col("notes") + 0.5) / (F.col("notes") + 0.5))
        weighed = stored(asked.join(frequency, "term").withColumn("idf", idf).drop("notes"), "weighed")
        blocks, scored = ceil(n / ASKED_TERMS), None
        for k in range(blocks):
            side = weighed.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == k) if blocks > 1 else weighed
            held = self.spark.sparkContext.broadcast(_asked(side.toArrow()))
            part = arrow_map(notes.select("note_id", "category", "length", "found"), _scores(held, mean, top), schema)
            scored = part if scored is None else scored.unionByName(part)
        order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "note_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    def _kind(self, version: int | None) -> str:
        notes = self._tables("notes", version)
        return "string" if notes is None else notes.schema["note_id"].dataType.simpleString()
