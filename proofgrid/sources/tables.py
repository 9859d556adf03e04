"""Headed tables, CSV grids and file admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from proofgrid.plans.storage import stored

# Accepted file endings and size limits in bytes per sheet family.
ENDINGS = (".xlsx", ".xls")
CERTIFICATE_LIMIT = 10 * 1024 * 1024
DOCUMENT_LIMIT = 50 * 1024 * 1024


def read_headed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A headed table from CSV (by ending) or Parquet, all CSV values as text."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


ROWS_PER_TASK = 50_000  # of a table that is compared row by row


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Spread a scan over all cores before costly comparisons, with at most about ``rows`` rows in a task.

    The rows of each partition are counted first, which reads no column: a file has more partitions than
    pieces that can be read apart, so many of them may be empty. A table whose partitions are small and
    at least as many as the cores comes back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total, most, filled = sizes.agg(F.sum("n"), F.max("n"), F.count("n")).first()
    if filled >= cores and most <= rows:
        return df
    return df.repartition(max(cores, -(-(total or 0) // rows)))


# A comma and a cell: quoted with doubled quotes inside, quoted without an end, or up to the next comma.
_CELL = r'(?s),("(?:[^"]++|"")*+"[^,]*+|".*+|[^,"][^,]*+|)'


def parse_record(record: Column) -> Column:
    """The cells of one CSV record, as many as it has; blank cells are null."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))

    def unquoted(cell: Column) -> Column:
        quote = F.lit('"')
        quoted = F.startswith(cell, quote) & F.endswith(cell, quote) & (F.char_length(cell) > 1)
        inside = F.replace(F.substring(cell, F.lit(2), F.char_length(cell) - 2), F.lit('""'), quote)
        return F.nullif(F.when(quoted, inside).otherwise(cell), F.lit(""))

    return F.transform(cells, unquoted)


def read_csv_grid(spark: SparkSession, path: str, n_columns: int = 0) -> DataFrame:
    """CSV files as ``rows(workbook, row_idx, values)``; the file path names the workbook.

    A row has as many cells as its record, padded to ``n_columns`` only where that is wider; nothing is cut.
    Quoted cells may hold commas, doubled quotes and line breaks (which become ``\\n``). Blank lines
    outside of quotes are no rows.

    Files are read once, line by line and in splits. Whether a line begins inside quotes follows from the
    quotes before it: those of its split and, by one sum per split, those of the splits before. Lines that
    begin inside quotes belong to the record before them, also across the border of two splits. So no
    file has to fit into one task; a split and a record do.
    """
    lines = stored(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("workbook"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"), F.col("value").alias("_line"),
            F.char_length(F.regexp_replace("value", '[^"]', "")).alias("_quotes"),
        ),
        "csv-lines",
    )
    splits = lines.groupBy("workbook", "_start").agg(F.sum("_quotes").alias("_n"))
    before = (
        Window.partitionBy("workbook").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    quotes_before = F.coalesce(F.sum("_n").over(before), F.lit(0))
    openings = splits.select("workbook", "_start", quotes_before.alias("_before"))
    in_split = (
        Window.partitionBy("workbook", "_start").orderBy("_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    quotes = F.col("_before") + F.coalesce(F.sum("_quotes").over(in_split), F.lit(0))
    placed = stored(
        lines.join(openings, ["workbook", "_start"])
        .withColumn("_outside", quotes % 2 == 0)
        .filter(~F.col("_outside") | (F.trim("_line") != ""))
        .withColumn("_begins", F.col("_outside").cast("int"))
        .withColumn("_nth", F.sum("_begins").over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_quotes", "_before", "_outside"),
        "csv-records",
    )
    starts = placed.groupBy("workbook", "_start").agg(F.sum("_begins").alias("_records")).select(
        "workbook", "_start", F.coalesce(F.sum("_records").over(before), F.lit(0)).alias("_shift")
    )
    records = (
        placed.join(starts, ["workbook", "_start"])
        .withColumn("row_idx", F.col("_nth") + F.col("_shift") - 1)
        .groupBy("workbook", "row_idx")
        .agg(F.array_sort(F.collect_list(F.struct("_start", "_id", "_line"))).alias("_lines"))
    )
    cells = parse_record(F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n"))
    missing = F.greatest(F.lit(0), F.lit(n_columns) - F.size("_cells"))
    return records.select("workbook", "row_idx", cells.alias("_cells")).select(
        "workbook", "row_idx",
        F.concat("_cells", F.array_repeat(F.lit(None).cast("string"), missing)).alias("values"),
    )


def wide_to_rows(df: DataFrame, columns: list[str], workbook: str, row_idx: str) -> DataFrame:
    """Columns of a table as sheet rows."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    return df.select(
        F.col(workbook).alias("workbook"), F.col(row_idx).cast("bigint").alias("row_idx"),
        cells.alias("values"),
    )


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name and size of files; the content column is not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path)
        .select("path", "length")
    )


def admit_files(
    files: DataFrame, limit: int = CERTIFICATE_LIMIT, endings: tuple[str, ...] = ENDINGS
) -> DataFrame:
    """Add ``accepted`` and the ``reason`` of a rejection."""
    lowered = F.lower("path")
    fits = F.lit(False)
    for ending in endings:
        fits = fits | F.endswith(lowered, F.lit(ending))
    reason = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("length") > limit, "file too large")
        .when(~fits, "invalid file format")
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
