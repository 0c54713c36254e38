"""Readers and writers: tables, info tables, PDF bytes, and outputs by case."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pdf import structure
from ..joins import join_keyed
from ..storage import stored
from ..tasks import arrow_map

#: A study as the info table of a case holds it.
STUDY = T.StructType(
    [
        T.StructField("case_name", T.StringType()),
        T.StructField("study_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("journal", T.StringType()),
    ]
)


#: Tables of so many splits or more are never dealt anew.
FEW_SPLITS = 32
#: Tasks a core that write small files.
TASKS_A_CORE = 2
#: A file has a split for so many bytes at least.
SPLIT_BYTES = 128 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A small table dealt over all cores, for costly work on rows that lie in a few splits; a larger one as it is.

    What it comes from is told by the number and size of the files below it, so that nothing runs before an action.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files, size = len(rows._jdf.inputFiles()), int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    splits = max(files, size // SPLIT_BYTES)
    return rows.repartition(cores) if splits < min(cores, FEW_SPLITS) else rows


def read_info_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The studies of one or more cases, under an explicit schema."""
    reader = spark.read.schema(STUDY)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


#: Columns that a row of an info table may have.
MOST_COLUMNS = 64


def read_damaged_info(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The studies of info tables in whatever state: the columns of `STUDY`, ``file`` and ``rescued``.

    Each file's first row names its columns, in any order and case, with or without spaces around; files
    needn't agree. rescued, a variant, has what the row shows besides, or null: values of unknown columns by
    their names, of repeated ones with their number, values beyond the header as ``column_9``, and known
    values that aren't of their type. So no row and no value is lost, and a row that is short has nulls. Quotes
    may hold line ends; one that is never closed takes the rest of its file into its field. A row of more
    than `MOST_COLUMNS` has its whole line in ``line``. Blank lines are no rows; an empty file has none.
    """
    raw = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(MOST_COLUMNS)] + [T.StructField("line", T.StringType())])
    reader = spark.read.schema(raw).option("sep", separator).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "line")
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file")).withColumn("place", F.monotonically_increasing_id())
    cells = F.array(*[f"c{k}" for k in range(MOST_COLUMNS)])
    rows = stored(rows.select("file", "place", cells.alias("cells"), F.when(F.col(f"c{MOST_COLUMNS - 1}").isNotNull(), F.col("line")).alias("line")), "info")
    # The first row of a file is the one with the least number, as a file with line ends in quotes is read in one go.
    heads = rows.groupBy("file").agg(F.min(F.struct("place", "cells")).alias("head"), F.count(F.lit(1)).alias("rows")).select("file", F.col("head.place").alias("first"), F.col("head.cells").alias("names"), "rows")
    met = join_keyed(rows, stored(heads, "heads"), "file", "rows", rows.count()).where("place > first")
    known = [f.name for f in STUDY]
    plain = F.transform("names", lambda n: F.lower(F.trim(n)))
    met = met.withColumn("plain", plain)
    value = {c: F.get("cells", (F.array_position("plain", c) - 1).cast("int")) for c in known}
    cast = {f.name: value[f.name].try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else value[f.name] for f in STUDY}

    def rest(k: Column) -> Column:
        name, at = F.get("plain", k), F.array_position("plain", F.get("plain", k)) - 1
        label = F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("column_"), k + 1)).when(at == k, name).otherwise(F.concat(name, F.lit("#"), k + 1))
        return F.struct(label.alias("key"), F.get("cells", k).alias("value"))

    bad = {c: F.col(f"__{c}").isNull() & value[c].isNotNull() for c in known if not isinstance(STUDY[c].dataType, T.StringType)}
    misfit = F.array(*[F.when(v, F.lit(c)) for c, v in bad.items()])
    every = F.transform(F.sequence(F.lit(0), F.lit(MOST_COLUMNS - 1)), rest)
    kept = F.filter(every, lambda x: x["value"].isNotNull() & (~x["key"].isin(known) | F.array_contains(misfit, x["key"])))
    kept = F.concat(kept, F.when(F.col("line").isNotNull(), F.array(F.struct(F.lit("line").alias("key"), F.col("line").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    rescued = F.when(F.size(kept) > 0, F.parse_json(F.to_json(F.map_from_entries(kept))))
    typed = met.select("*", *[cast[c].alias(f"__{c}") for c in known])
    return typed.select(*[F.col(f"__{c}").alias(c) for c in known], "file", rescued.alias("rescued"))


def download_input(info: DataFrame, case_name: str | None = None) -> DataFrame:
    """What a download needs of an info table: one row a study of the case, DOIs lower-cased."""
    rows = info if case_name is None else info.where(F.col("case_name") == case_name)
    return rows.select("case_name", "study_id", F.lower(F.trim("doi")).alias("doi"), "author", "year", "title").dropDuplicates(["case_name", "study_id"])


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: ``path, length, modified, header, valid``; valid: it begins as a PDF does.

    Spark's file reader doesn't list files without any bytes: those count as not fetched.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    header = F.substring(F.col("content"), 1, 5)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), header.alias("header"), ((F.col("length") > 0) & (header == F.lit(b"%PDF-"))).alias("valid"))


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # one file at a time, as each may be large
            made = structure(batch.column(1)[k].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *[pa.array([v], t) for v, t in zip(made, (pa.string(), pa.string(), pa.int64(), pa.int64()))]], ["path", "state", "version", "objects", "misplaced"])


def pdf_structures(files: DataFrame) -> DataFrame:
    """``path, state, version, objects, misplaced`` of files (``path, content``), by their bytes alone, see `structure`."""
    return arrow_map(files.select("path", "content"), _structures, "path string, state string, version string, objects long, misplaced long")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """`pdf_structures` of all files below a folder, those without any bytes included.

    Spark's file reader passes over the latter; their names come from the list of files that it keeps on the
    driver anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = stored(pdf_structures(files), "structures")
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "path string")
    # Listed names are escaped as in a URI, those of the reader are not.
    listed = listed.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/{1,3}", "$1:/")
    empty = listed.withColumn("__plain", plain("path")).join(found.select(plain("path").alias("__plain")), "__plain", "left_anti")
    none = empty.select("path", F.lit("empty").alias("state"), F.lit(None).cast("string").alias("version"), F.lit(0).cast("long").alias("objects"), F.lit(0).cast("long").alias("misplaced"))
    return found.unionByName(none)


def write_files(rows: DataFrame, key: str, path: str) -> None:
    """A file of its own below ``path`` for each row (``key``, and a text ``value``), in the folder ``key=...``.

    Rows are dealt over all cores, however few splits they lie in, as making a file takes much longer than
    its row; and each task moves its own files to their place, which otherwise the driver does one by one.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE, 1)
    rows.repartition(tasks, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(path)


def fetched_pdfs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, length, state`` for each path of a manifest: valid, not_pdf, or missing.

    manifest: ``path``; files: what `read_pdfs` found. A file without any bytes counts as missing, as
    the reader doesn't list it. Repeated paths count once; null paths are left out; files that the
    manifest doesn't name play no part.
    """
    state = F.when(F.col("valid"), "valid").when(F.col("length").isNull(), "missing").otherwise("not_pdf")
    wanted = manifest.select("path").where("path IS NOT NULL").distinct()
    return wanted.join(files.select("path", "length", "valid"), "path", "left").select("path", "length", state.alias("state"))


def write_by_case(rows: DataFrame, path: str) -> None:
    """Append below ``path``, a folder for each case."""
    rows.write.partitionBy("case_name").mode("append").parquet(path)


def resolve_case(cases: DataFrame, name: str | None = None) -> str:
    """The named case, or the only one there is. None or several without a name is an error."""
    if name is not None:
        return name
    found = [r[0] for r in cases.select("case_name").where("case_name IS NOT NULL").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("no case found" if not found else "several cases found: name one")
    return found[0]
