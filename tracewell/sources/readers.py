"""Scans: trajectory files, event logs, manifests, JDBC tables and stage hand-over files."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.scalars import to_number

CORRUPT = "_corrupt_record"


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text plus the corrupt-record column; numbers are coerced later."""
    return T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(CORRUPT, T.StringType())])


def file_order():
    """Place of a row in its file: where the split starts, then the running id of the task, so large files are read in parallel."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def scan_trajectories(
    spark: SparkSession, root: str, columns: Sequence[str], t: str = "TIME", class_dir: str | None = r"/([^/]+)/[^/]+$",
    id_pattern: str | None = r"/([^/]+)\.csv$", glob: str = "*.csv", ordinal: str | None = None,
) -> DataFrame:
    """All trajectory CSVs below `root` as one table with class and id taken from the path, and each row's place in its file as `ordinal`.

    One declared schema, so no inference pass; unreadable numbers become NULL and
    malformed lines stay visible in the corrupt-record column.
    """
    raw = (
        spark.read.schema(text_schema(columns)).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(root)
    )
    path = F.col("_metadata.file_path")
    meta = [path.alias("source_file")]
    if ordinal:
        meta.append(file_order().alias(ordinal))
    if class_dir:
        meta.append(F.regexp_extract(path, class_dir, 1).alias("class"))
    if id_pattern:
        meta.append(F.regexp_extract(path, id_pattern, 1).alias("case_id"))
    values = [to_number(c).alias("t" if c == t else c) for c in columns]
    return raw.select(*meta, *values, CORRUPT)


#: A comma outside double quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_OPEN = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes wrong when a compressed file is read to its end; nothing for files that are whole."""
    for batch in batches:
        path, why = [], []
        for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with _OPEN[p[p.rindex("."):]](io.BytesIO(content)) as f:
                    while f.read(1 << 20):
                        pass
            except (OSError, EOFError, zlib.error, lzma.LZMAError) as x:
                path.append(p)
                why.append(f"{type(x).__name__}: {x}")
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(why, pa.string())], names=["file", "detail"])


def _cells(line: Column) -> Column:
    cells = F.split(F.regexp_replace(line, "\r$", ""), _COMMA, -1)
    return F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), '""', '"'))


def scan_checked(spark: SparkSession, root: str, columns: Sequence[str], glob: str = "*.csv*") -> tuple[DataFrame, DataFrame]:
    """CSVs below `root` that may be damaged: the rows that can be read, and what could not be.  No file fails the job.

    Rows have `file`, `line` (the header is line 1), `place` (their order in the file) and `columns` as numbers, found by the names in the
    file's own header.  Faults have file, line, error and detail:

    unreadable       nothing could be read; or a compressed file ends in damage, then what comes before it is among the rows
    empty            the file has no byte or no line, or no row below its header
    missing_columns  the header lacks some of `columns`: these are NULL in the rows; detail names them
    repeated_columns the header has a name twice: the first one counts
    cells            a line has more or fewer cells than the header: it is not among the rows
    number           a cell is no number: it is NULL in its row; detail names the columns

    Blank lines are skipped, a cell holds no line break.  A compressed file is held whole by the task that tests it.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(root)
    lines = text.select(F.col("_metadata.file_path").alias("file"), file_order().alias("place"), "value")
    # Ids run on without a gap inside a split, so a few numbers for each split give every line its number.
    per = lines.groupBy("file", "place.block").agg(F.count(F.lit(1)).alias("_n"), F.min("place.row").alias("_row"), F.min_by("value", "place.row").alias("_top"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    names = F.first(F.when(F.col("block") == 0, _cells(F.col("_top"))), ignorenulls=True).over(Window.partitionBy("file"))
    split = per.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_names", names).drop("_top", "_n")
    split = split.select(*[F.col(c).alias(f"_s_{c}" if c in ("file", "block") else c) for c in split.columns])
    numbered = lines.join(split, (F.col("file") == F.col("_s_file")) & (F.col("place.block") == F.col("_s_block")))
    numbered = numbered.withColumn("line", F.col("_before") + F.col("place.row") - F.col("_row") + 1).where((F.col("line") > 1) & (F.trim("value") != ""))
    cells = numbered.withColumn("_cells", _cells(F.col("value"))).withColumn("_whole", F.size("_cells") == F.size("_names"))
    found = [F.get("_cells", F.nullif(F.array_position("_names", F.lit(c)), F.lit(0)).cast("int") - 1) for c in columns]
    odd = F.array_compact(F.array(*[F.when((F.trim(x) != "") & _number(x).isNull(), F.lit(c)) for c, x in zip(columns, found, strict=True)]))
    rows = cells.where("_whole").select("file", "line", "place", *[_number(x).alias(c) for c, x in zip(columns, found, strict=True)])
    short = cells.where("not _whole").select("file", "line", F.lit("cells").alias("error"), F.concat(F.size("_cells").cast("string"), F.lit(" of "), F.size("_names").cast("string")).alias("detail"))
    bad = cells.where("_whole").select("file", "line", F.lit("number").alias("error"), F.array_join(odd, ";").alias("detail")).where("detail <> ''")
    want = F.array(*[F.lit(c) for c in columns])
    heads = split.where("_s_block = 0").select(F.col("_s_file").alias("file"), "_names").withColumn("_lacks", F.array_join(F.array_except(want, "_names"), ";"))
    lacking = heads.where("_lacks <> ''").select("file", F.lit(1).alias("line"), F.lit("missing_columns").alias("error"), F.col("_lacks").alias("detail"))
    twice = heads.where(F.size(F.array_distinct("_names")) < F.size("_names")).select("file", F.lit(1).alias("line"), F.lit("repeated_columns").alias("error"), F.lit(None).cast("string").alias("detail"))
    # A scan passes over files without a byte; the names that the driver has listed for it tell them.
    every = spark.createDataFrame([(f,) for f in listed.inputFiles()], "file string").select(_plain_path(F.col("file")).alias("file"))
    files = every.join(listed.select(_plain_path(F.col("path")).alias("file"), "length"), "file", "left")
    read = lines.groupBy(_plain_path(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("_n"))
    none = files.join(read, "file", "left").where("coalesce(_n, 0) < 2")
    none = none.select("file", F.lit(None).cast("long").alias("line"), F.when((F.col("length") > 0) & F.col("_n").isNull(), "unreadable").otherwise("empty").alias("error"), F.lit(None).cast("string").alias("detail"))
    # A scan of contents reads every file that its glob lets through, whatever is filtered later, so it has a glob of its own.
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{gz,bz2,xz}").load(root)
    packed = whole.select("path", "content").mapInArrow(_damage, "file string, detail string")
    packed = packed.select(_plain_path(F.col("file")).alias("file"), F.lit(None).cast("long").alias("line"), F.lit("unreadable").alias("error"), "detail")
    packed = packed.join(every, "file", "left_semi")
    none = none.join(packed.select("file"), "file", "left_anti")
    faults = [x.withColumn("file", _plain_path(F.col("file"))).withColumn("line", F.col("line").cast("long")) for x in (short, bad, lacking, twice)] + [none, packed]
    return rows.withColumn("file", _plain_path(F.col("file"))), reduce(DataFrame.unionByName, faults)


def _plain_path(path: Column) -> Column:
    """The path without its scheme; readers and listings spell it in different ways."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def _number(cell: Column) -> Column:
    return F.nullif(F.trim(cell), F.lit("")).try_cast("double")


def numeric_order(df: DataFrame, case: str = "case_id") -> DataFrame:
    """Sort key for file stems: trailing digits as a number, then the text."""
    return df.withColumn("case_number", F.expr(f"try_cast(regexp_extract({case}, '(\\\\d+)$', 1) AS BIGINT)"))


def scan_logs(spark: SparkSession, root: str, glob: str = "*.txt", id_pattern: str = r"/([^/]+)\.txt$") -> DataFrame:
    """Event logs line by line with their file id and their place in the file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("sample_id"),
        file_order().alias("line_no"),
        F.col("value").alias("line"),
    )


def first_rows_only(df: DataFrame, columns: Sequence[str], id: str, t: str = "t") -> DataFrame:
    """Column-pruned first row of each trajectory."""
    return df.groupBy(id).agg(F.min_by(F.struct(*columns), t).alias("_f")).select(id, "_f.*")


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower=None, upper=None, parts: int = 32) -> DataFrame:
    """Generic JDBC scan, split over `partition_column` when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
        )
    return reader.load()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in `order` (dropDuplicates does not promise which row stays).

    row_number() = 1 is cut down inside each input partition before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def scenario_manifest(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.where(F.col(category) == value)


def text_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans written as text (True / true / TRUE) back to booleans."""
    return df.select(*[(F.lower(F.col(c).cast("string")) == "true").alias(c) if c in columns else F.col(c) for c in df.columns])
