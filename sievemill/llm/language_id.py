"""Language identification by Bayesian evidence fusion.

A text's letter trigrams give log likelihoods by language. To them are added what the markup declares,
the address suffix, and a prior of the host: counts of text-only decisions by language, smoothed from
the whole corpus to the site and from the site to the host. All these tables come from grouped
aggregation over all documents; only the trigram model is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_seeds import SEEDS
from .minhash import _slices
from .mixing import document_hash
from .shared import arrow_map, join_keyed, spread, stored, text_bytes, unused

LANGUAGES = ("de", "en", "es", "fr")
#: About so many declared texts of each language fit the trigram model.
SAMPLE = 1_500
CELLS = 1 << 15
#: Trigrams of one text overlap; together they count as so many independent ones at most.
EVIDENCE = 40.0
#: Weight of the wider level in the counts of the narrower one.
SMOOTHING = 10.0
LEAST = 0.5
#: A trigram of a text must be likelier by so much in its best language than among letters in any order;
#: a short text's mean may fall below by SLACK over the root of its trigrams.
FIT, SLACK = 1.0, 5.0
#: A language with fewer declared texts is known from the seeds of `language_seeds` too, each counted so often.
FEWEST, SEED_WEIGHT = 20, 20

_KIND = np.full(256, 32, np.uint8)
_KIND[65:91] = np.arange(97, 123)
_KIND[97:123] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)


def trigram_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of all trigrams that hold a letter, and the text of each; ASCII letters in lower case, other ASCII as space."""
    raw, at = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _KIND[raw].astype(np.uint32)
    before, after = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    before[1:], after[:-1] = b[:-1], b[1:]
    inner = at[(at > 0) & (at < len(b))]
    before[inner], after[inner - 1] = 32, 32  # texts stand between spaces
    solid = b != 32
    cells = ((before << 16 | b << 8 | after)[solid] * np.uint32(2654435761)) >> np.uint32(32 - 15)
    return cells.astype(np.int64), np.repeat(np.arange(len(at) - 1), np.diff(at))[solid]


def _counted(languages: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        total = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            for part in _slices(batch, 1):
                cells, owner = trigram_cells(part.column(1))
                of = np.array([languages.index(x) for x in part.column(0).to_pylist()], np.int64)
                if len(cells):
                    total += np.bincount(of[owner] * CELLS + cells, minlength=total.size).reshape(total.shape)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(cell, pa.int64()), pa.array(total[lang, cell])], ["lang", "cell", "n"])

    return run


def fitted_model(texts: DataFrame, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE, by: str = "id") -> tuple[np.ndarray, list[str]]:
    """Log probabilities by cell and language, from about ``sample`` declared texts of each, and the languages that the seeds had to help.

    texts: ``id, text, declared``. The sample is a threshold on a hash of ``by``, so reruns agree. The
    counts that reach the driver are bounded by cells times languages. A language with fewer than
    `FEWEST` declared texts is known from its seeds as well; one that has none of these is an error.
    """
    declared = texts.where(F.col("declared").isin(*languages))
    sizes = {r["declared"]: r["n"] for r in declared.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    helped = [x for x in languages if sizes.get(x, 0) < FEWEST]
    if unknown := [x for x in helped if x not in SEEDS]:
        raise ValueError(f"fewer than {FEWEST} texts declare {', '.join(unknown)}, and no seeds are known: give a model")
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("declared") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = declared.where(document_hash(F.col(by), "train") < share * float(2**60)).select("declared", "text")
    counts = np.zeros((CELLS, len(languages)))
    for r in arrow_map(chosen, _counted(list(languages)), "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"], r["lang"]] = r["n"]
    for x in helped:
        cells, _ = trigram_cells(pa.array([SEEDS[x]]))
        counts[:, list(languages).index(x)] += SEED_WEIGHT * np.bincount(cells, minlength=CELLS)
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * CELLS)).astype(np.float32), helped


def trigram_model(texts: DataFrame, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE, by: str = "id") -> np.ndarray:
    """The model of `fitted_model` alone."""
    return fitted_model(texts, languages, sample, by)[0]


@cache
def background() -> np.ndarray:
    """Log probabilities by cell of trigrams whose bytes follow each other in any order, whatever the language."""
    share = np.zeros(256)
    share[32], share[97:123], share[128:] = 0.17, 0.77 / 26, 0.06 / 128
    b = np.flatnonzero(share)
    of = b.astype(np.uint32)
    grams = of[:, None, None] << np.uint32(16) | of[None, :, None] << np.uint32(8) | of[None, None, :]
    odds = share[b][:, None, None] * share[b][None, :, None] * share[b][None, None, :]
    solid = np.broadcast_to((b != 32)[None, :, None], grams.shape)
    total = np.bincount((grams[solid] * np.uint32(2654435761)) >> np.uint32(32 - 15), odds[solid], CELLS)
    return np.log(total / total.sum() + 1e-12).astype(np.float32)


def text_likelihoods(texts: DataFrame, model: np.ndarray, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``id, declared, host, site, suffix, grams, fits`` and a log likelihood ``ll`` for each language, of whole texts.

    fits: in the best language the text's trigrams are likelier than in no language, see `FIT`.
    """
    held = texts.sparkSession.sparkContext.broadcast((model, background()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        table, none = held.value
        for batch in batches:
            for part in _slices(batch, 1):
                cells, owner = trigram_cells(part.column(1))
                n = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
                ll = np.stack([np.bincount(owner, table[cells, k], part.num_rows) for k in range(table.shape[1])], axis=1).astype(float)
                above = (ll.max(axis=1) - np.bincount(owner, none[cells], part.num_rows)) / np.maximum(n, 1)
                fits = above + SLACK / np.sqrt(np.maximum(n, 1)) >= FIT
                ll *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(ll.reshape(-1)), table.shape[1]).cast(pa.list_(pa.float64()))
                others = [part.column(k) for k in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *others, pa.array(n), pa.array(fits), lists], [part.schema.names[0], *part.schema.names[2:], "grams", "fits", "ll"])

    rows = spread(texts.select("id", "text", "declared", "host", "site", "suffix"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, declared string, host string, site string, suffix string, grams long, fits boolean, ll array<double>")


def _counts(rows: DataFrame, column: str, languages: Sequence[str]) -> DataFrame:
    """Text-only decisions by language, as an array, for each value of a column that a decided text has, and all rows of the value."""
    sums = F.array(*[F.coalesce(F.sum((F.col("by_text") == x).cast("double")), F.lit(0.0)) for x in languages])
    grouped = rows.where(F.col(column).isNotNull()).groupBy(column).agg(sums.alias(f"{column}_n"), F.count("by_text").alias("known"), F.count(F.lit(1)).alias("rows"))
    return grouped.where("known > 0").drop("known")


def _fusing(languages: Sequence[str], prior: np.ndarray, totals: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(languages)
        names = np.array([*languages, "und"])

        def matrix(column: pa.Array) -> np.ndarray:
            return np.array([x or [0.0] * size for x in column.to_pylist()], float).reshape(-1, size)

        def known(column: pa.Array, total: np.ndarray) -> np.ndarray:
            return np.where(column.is_valid().to_numpy(zero_copy_only=False)[:, None], np.log((matrix(column) + 1) / total), 0.0)

        for batch in batches:
            of = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            ll, some = matrix(of["ll"]), (of["grams"].to_numpy() > 0) & of["fits"].to_numpy(zero_copy_only=False)
            by_text = np.where(some, ll.argmax(axis=1), size) if len(ll) else np.zeros(0, np.int64)
            own = np.eye(size + 1)[by_text][:, :size]  # a text's own decision is taken out of its site and host
            site, host = (np.maximum(matrix(of[c]) - own, 0) for c in ("site_n", "host_n"))
            site = (site + SMOOTHING * prior) / (site.sum(axis=1, keepdims=True) + SMOOTHING)
            host = (host + SMOOTHING * site) / (host.sum(axis=1, keepdims=True) + SMOOTHING)
            score = ll + np.log(host) + sum(known(of[f"{c}_n"], totals[c]) for c in totals)
            share = np.exp(score - score.max(axis=1, keepdims=True)) if len(ll) else score
            share /= share.sum(axis=1, keepdims=True)
            best = np.where(some, score.argmax(axis=1), size) if len(ll) else by_text
            posterior = np.where(some, share.max(axis=1), 0.0) if len(ll) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [of["id"], of["declared"], pa.array(names[by_text].tolist(), pa.string()), pa.array(names[best].tolist(), pa.string()), pa.array(posterior)],
                ["id", "declared", "by_text", "lang", "posterior"],
            )

    return run


def fuse(scored: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``id, declared, by_text, lang, posterior`` for every row of `text_likelihoods`.

    Every declared value and suffix is evidence; what reaches the driver is one row for each language and
    column. A text that doesn't fit (all do, where there is no such column) counts nowhere and is ``und``.
    """
    scored = scored if "fits" in scored.columns else scored.withColumn("fits", F.lit(True))
    best = F.array_max(F.transform(F.col("ll"), lambda x, k: F.struct(x, -k)))["col2"]
    scored = stored(scored.withColumn("by_text", F.when((F.col("grams") > 0) & F.col("fits"), F.element_at(F.array(*map(F.lit, languages)), 1 - best))), "likelihoods")
    total = {r["by_text"]: r["count"] for r in scored.groupBy("by_text").count().collect()}
    prior = np.array([total.get(x, 0) + 1.0 for x in languages])
    totals, rows = {}, scored
    for column in ("declared", "suffix", "site", "host"):
        counts = stored(_counts(scored, column, languages), f"{column}-counts")
        if column in ("declared", "suffix"):
            sums = counts.agg(F.count(F.lit(1)), *[F.sum(F.col(f"{column}_n")[k]) for k in range(len(languages))]).first()
            totals[column] = np.array([x or 0.0 for x in sums[1:]]) + sums[0] + 1.0
        rows = join_keyed(rows, counts, column, "rows", sum(total.values()), "left")
    rows = rows.select("id", "declared", "grams", "fits", "ll", "declared_n", "suffix_n", "site_n", "host_n")
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, _fusing(tuple(languages), prior / prior.sum(), totals), f"id {kind}, declared string, by_text string, lang string, posterior double")


def identify(
    texts: DataFrame, languages: Sequence[str] = LANGUAGES, accepted: Sequence[str] | None = None, least: float = LEAST, sample: int = SAMPLE, by: str = "id",
    model: np.ndarray | None = None, strict: bool = True,
) -> DataFrame:
    """Language of every whole text: ``id, declared, by_text, lang, posterior, kept``, one row per row.

    texts: ``id, text, declared, host, site, suffix``; all but id may be null, and missing evidence is
    left out (a null host or site falls back to the next wider counts). A text without a letter, an
    empty or null one, or one that fits none of ``languages`` is ``und`` with posterior 0 and is not kept. kept: the language is one of
    ``accepted`` (all, if not given) with a posterior of at least ``least``. Equal scores go to the
    first language. Rows that repeat each get their answer, also under a null id. Other columns play
    no part. An empty table gives an empty one. Counts of values that very many rows share reach those
    rows by broadcast, the others by shuffle.

    model: of `trigram_model`, from other texts; without it the table's own declared texts make one. How
    well a text fits is judged only against a model that all ``languages`` have given enough texts to, or
    a given one. strict: such a text is ``und`` whatever it declares; otherwise only if it declares another language.
    """
    texts = texts.select("id", "text", "declared", "host", "site", "suffix")
    helped: list[str] = []
    if model is None:
        model, helped = fitted_model(texts, languages, sample, by)
    scored = text_likelihoods(texts, model, languages)
    if helped:
        scored = scored.withColumn("fits", F.lit(True))
    elif not strict:
        scored = scored.withColumn("fits", F.col("fits") | F.col("declared").isNull() | F.col("declared").isin(*languages))
    found = fuse(scored, languages)
    keep = F.col("lang").isin(*(accepted if accepted is not None else languages)) & (F.col("posterior") >= least)
    return found.select("id", "declared", "by_text", "lang", "posterior", keep.alias("kept"))


def primary_tag(tag: Column) -> Column:
    """The language of a tag such as ``en``, ``en-US`` or ``EN_gb``, in lower case; a null or blank one is null."""
    return F.nullif(F.lower(F.regexp_extract(tag, r"^\s*([^\s_-]*)", 1)), F.lit(""))


def of_documents(docs: DataFrame) -> DataFrame:
    """Input of `identify` from documents: the lang column is what was declared, the source is the host. Site and suffix come from a ``url`` column, if there is one."""
    return docs.select(F.col("doc_id").alias("id"), "text", *_evidence(docs))


def _address(url: Column) -> tuple[Column, Column, Column]:
    """Host, site (its last two labels) and suffix of an address; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    site = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return tuple(F.nullif(x, F.lit("")) for x in (host, site, F.element_at(labels, -1)))


def _evidence(docs: DataFrame) -> list[Column]:
    url = F.col("url").cast("string") if "url" in docs.columns else F.lit(None).cast("string")
    _, site, suffix = _address(url)
    return [primary_tag(F.col("lang")).alias("declared"), F.col("source").alias("host"), site.alias("site"), suffix.alias("suffix")]


def of_pages(pages: DataFrame) -> DataFrame:
    """Input of `identify` from pages: visible text, the markup's lang, and the address's host, site and suffix."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    host, site, suffix = _address(F.col("url"))
    return pages.select(F.col("page_id").alias("id"), visible.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), host.alias("host"), site.alias("site"), suffix.alias("suffix"))


def identify_documents(docs: DataFrame) -> DataFrame:
    found = identify(of_documents(docs))
    return found.withColumnRenamed("id", "doc_id")


def _row_key(docs: DataFrame) -> Column:
    """A digest of all that a document's decision depends on, and of its id."""
    columns = ["doc_id", "lang", "source", "text", *(["url"] if "url" in docs.columns else [])]
    parts = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(" ", *parts), 256)


#: Rejected rows' digests up to which they are broadcast.
BROADCAST_ROWS = 200_000


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known well enough, with all their columns.

    What goes: texts without a letter, those whose language stays open (posterior under `LEAST`), and those that
    declare a language which isn't one of the known ones and whose text doesn't fit these either. A text
    without a declared language stays, and so does one that declares a known one in whatever prose. A
    table that declares nothing, or too little, is judged by the seeds of `language_seeds`.
    Rows are told apart by id, language, source, text (and address, if there is one) together, as ids
    may repeat or be null: a rejected row takes no other with it. Other columns may have any names.
    """
    key = unused(docs, "key")
    texts = docs.select(F.struct("doc_id", _row_key(docs).alias("key")).alias("id"), "text", *_evidence(docs))
    found = identify(texts, by="id.doc_id", strict=False).where("NOT kept").groupBy(F.col("id.key").alias(key)).agg(F.count(F.lit(1)).alias("rows"))
    gone = stored(found, "rejected")
    keyed = docs.withColumn(key, _row_key(docs))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(gone.select(key)), key, "left_anti").drop(key)
    # Rejected rows that repeat very often must not meet in one task.
    rows = keyed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"))
    gone = gone.select(F.col(key).alias("key"), F.lit(True).alias("gone"), "rows")
    return join_keyed(rows, gone, "key", "rows", gone.agg(F.sum("rows")).first()[0], "left").where("gone IS NULL").select("row.*")
