"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over a text's distinct words and the
beginnings of its longer words. Each later model also sees the probabilities of the earlier categories:
in training those of models that have not seen the text or a near copy of it (out of fold), in scoring
those of the final models. Models are fitted on a bounded sample of labelled texts; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import _sign, _slices
from .mixing import document_hash
from .shared import arrow_map, spread, text_bytes
from .shingles import LETTERS, prefix_hashes, word_hashes, word_spans

BITS = 18
#: Bytes of the beginnings of longer words, which inflected forms share.
STEMS = (4, 5, 6)
#: About so many labelled texts fit the models.
SAMPLE = 20_000
FOLDS, STEPS, PENALTY, SEEN, SIGMAS = 3, 150, 1e-5, 3, 4.0


def word_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of each text's distinct words and beginnings of words, and the n + 1 offsets of the texts among them."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    start, end = word_spans(raw, offsets, LETTERS)
    owner = np.searchsorted(offsets, start, "right") - 1
    hashes, owners = [word_hashes(raw, offsets, LETTERS)[0]], [owner]
    for length in STEMS:
        stem, longer = prefix_hashes(raw, start, end, length)
        hashes.append(stem)
        owners.append(owner[longer])
    cells = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(np.concatenate(owners) << BITS | cells)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(n + 1))


@dataclass
class Linear:
    """Weights by word cell, by earlier category, and a constant."""

    words: np.ndarray
    earlier: np.ndarray
    constant: float

    def log_odds(self, cells: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.words[cells], dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]] + before @ self.earlier + self.constant


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def _tally(cells: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """How often each cell occurs, counted by parts."""
    found = np.zeros(size, np.int64)
    for i in range(0, len(cells), step):
        found += np.bincount(cells[i : i + step], minlength=size)
    return found


def fit_linear(cells: np.ndarray, at: np.ndarray, before: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression on the word cells that differ between the classes.

    A cell keeps weight 0 unless it is in SEEN texts and its share of positive ones is SIGMAS standard
    errors off. Accelerated gradient steps are scaled by a bound of each weight's curvature, so they
    settle whatever the lengths of the texts.
    """
    n, size, width = len(y), 1 << BITS, before.shape[1]
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    constant = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Linear(np.zeros(size, np.float32), np.zeros(width), constant)
    sizes = np.diff(at)
    seen, hits = _tally(cells, size), _tally(cells[np.repeat(y > 0, sizes)], size)
    spread = seen * share * (1 - share) * (1 - seen / n)
    usable = (seen >= SEEN) & ((hits - seen * share) ** 2 >= SIGMAS**2 * np.maximum(spread, 1e-9))
    chosen = np.flatnonzero(usable)
    mask = usable[cells]
    column, row = np.searchsorted(chosen, cells[mask]), np.repeat(np.arange(n, dtype=np.int32), sizes)[mask]
    k = len(chosen)
    count = np.bincount(row, minlength=n) + np.abs(before).sum(axis=1) + 1.0  # of a text's terms
    bound = 0.25 / n * np.concatenate([np.bincount(column, count[row], k), np.abs(before).T @ count, [count.sum()]]) + PENALTY
    w = np.concatenate([np.zeros(k + width), [constant]])
    ahead, last, momentum = w.copy(), w, 1.0
    for _ in range(STEPS):
        odds = np.bincount(row, ahead[:k][column], n) + before @ ahead[k:-1] + ahead[-1]
        error = (probability(odds) - y) / n
        slope = np.concatenate([np.bincount(column, error[row], k), error @ before, [error.sum()]])
        slope[:-1] += PENALTY * ahead[:-1]
        w = ahead - slope / bound
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, last, momentum = w + (momentum - 1) / grown * (w - last), w, grown
    words = np.zeros(size, np.float32)
    words[chosen] = w[:k]
    return Linear(words, w[k:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1, half way to the next lower probability; 0.5 without a positive text."""
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal probabilities
    k = int(f1.argmax())
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]
    out_of_fold: np.ndarray

    def probabilities(self, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = np.zeros((len(at) - 1, 0))
        for model in self.models:
            found = np.hstack([found, probability(model.log_odds(cells, at, found))[:, None]])
        return found


def fit_chain(cells: np.ndarray, at: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: Sequence[str]) -> Chain:
    """labels: one column a category, in the chain's order."""
    chain = Chain(list(categories), [], [], np.zeros((len(labels), 0)))
    # Cells of fewer than SEEN texts get no weight in any fit, so they go first.
    often = (_tally(cells, 1 << BITS) >= SEEN)[cells]
    at = np.concatenate([[0], np.cumsum(often)])[at]
    cells, sizes = cells[often], np.diff(at)

    def rows(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cells[np.repeat(mask, sizes)], np.concatenate([[0], np.cumsum(sizes[mask])])

    for c in range(len(categories)):
        y, before = labels[:, c].astype(float), chain.out_of_fold
        unseen = np.zeros(len(y))
        for held in (fold == k for k in range(FOLDS)):
            unseen[held] = probability(fit_linear(*rows(~held), before[~held], y[~held]).log_odds(*rows(held), before[held]))
        chain.models.append(fit_linear(cells, at, before, y))
        chain.thresholds.append(best_threshold(unseen, labels[:, c]))
        chain.out_of_fold = np.hstack([before, unseen[:, None]])
    return chain


def kin(bands: np.ndarray) -> np.ndarray:
    """For each text the first one that it is tied to by shared MinHash bands, one row of bands a text; texts in a row may be tied through others."""
    of = np.arange(len(bands))
    keys = [np.unique(bands[:, j], return_inverse=True)[1] for j in range(bands.shape[1])]
    while len(of):
        before = of.copy()
        for key in keys:
            least = np.full(key.max() + 1, len(of))
            np.minimum.at(least, key, of)
            of = least[key]
        if (of == before).all():
            break
    return of


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> Chain:
    """Fits the chain on about ``sample`` labelled texts, chosen by a threshold on a hash of their ids.

    Labels with a null id or value are left out; of repeated ids the largest values count. The chosen
    labels are bounded by the sample, so they are broadcast, and their word cells come to the driver.
    Texts that share a MinHash band, and so all near copies, are in one fold.
    """
    values = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(v.cast("int")).alias(f"y{k}") for k, v in enumerate(categories.values())]).dropna()
    n = values.count()
    share = min(1.0, sample / n) if n else 0.0
    chosen = values.where(document_hash(F.col("doc_id"), "train") < F.lit(share * float(2**60)))
    ys = [f"y{k}" for k in range(len(categories))]
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in _slices(batch, 1):
                cells, at = word_cells(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cells, pa.int32()))
                bands = pa.concat_arrays([b.column("bands") for b in _sign(iter([part.select([0, 1])]))])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists, bands, *(part.column(k) for k in range(2, part.num_columns))], ["doc_id", "cells", "bands", *ys])

    rows = arrow_map(spread(found), run, "doc_id long, cells array<int>, bands array<long>, " + ", ".join(f"{y} int" for y in ys)).orderBy("doc_id").toArrow()
    lists = rows.column("cells").combine_chunks()
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    cells = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int32)
    y = np.stack([rows.column(c).to_numpy() for c in ys], axis=1) if len(lists) else np.zeros((0, len(ys)))
    first = kin(rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.int64))
    # Folds by a mix of the id, not by its place among the chosen.
    fold = ((rows.column("doc_id").to_numpy()[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS
    del rows, lists
    return fit_chain(cells, at, y, fold, list(categories))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, and for each category its probability ``p_<name>`` and decision ``<name>``, one row per row.

    A text without words, or null, has the constant terms' probabilities and is in no category. Repeated
    rows and null ids get their answer; other columns play no part. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        chain = held.value
        for batch in batches:
            for part in _slices(batch, 1):
                cells, at = word_cells(part.column(1))
                p = chain.probabilities(cells, at)
                some = np.diff(at) > 0
                columns, names = [part.column(0)], ["doc_id"]
                for k, name in enumerate(chain.categories):
                    columns += [pa.array(p[:, k]), pa.array((p[:, k] >= chain.thresholds[k]) & some)]
                    names += [f"p_{name}", name]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"p_{c} double, {c} boolean" for c in chain.categories))


def toxicity_categories() -> dict[str, Column]:
    """The chain over the labels table: worthless text first, then toxic text."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train_chain(docs, labels, toxicity_categories(), sample))
