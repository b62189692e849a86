"""Frequency of every distinct term, out of core (problem 2).

Method: recursive radix spilling. The terms of each record are counted within the record, so a row is
(field, term, occurrences) and stands for one record. Rows are combined in every task before they
move, so a term that stands in a third of all records sends a row a task, not a row a record. The
combined rows are moved once, by the leading bits of their hash, and written as one folder a partition
below the shared folder. A partition of more than ``PARTITION_ROWS`` rows is read again and split by the next bits, again
and again, until each is small enough or holds one term; the others stay as they are. DuckDB then
aggregates each partition from its folder, out of core: with a memory limit and a spill folder beside it.

Defined results: null and blank values are no terms; a term is trimmed, its inner white space is one
blank, its letters are lower case; every row of a table is a record, repeated rows too; null lists hold
no terms; an empty table gives no rows; other columns are not carried along.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws
from ..session import drop_path, materialise, scratch_path

RARE_BELOW = 3
COMMON_ABOVE = 0.2
FIRST_BITS = 6
NEXT_BITS = 4
PARTITION_ROWS = 2_000_000
COMBINE_ROWS = 500_000
MEMORY = "300MB"

_COMBINED = "field_name string, term string, occurrences long, records long"


def record_terms(lists: DataFrame) -> DataFrame:
    """(field_name, term, occurrences), one row per record and term, of (field_name, items array)."""
    terms = F.filter(F.transform("items", lambda x: F.lower(collapse_ws(x))), lambda x: x.isNotNull() & (x != ""))
    counted = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).cast("long").alias("occurrences")))
    return lists.select("field_name", terms.alias("terms")).select("field_name", F.explode(counted).alias("t")).select("field_name", "t.term", "t.occurrences")


def _aggregate(rows: pa.Table | pa.RecordBatchReader, spill: str):
    """``spill``: DuckDB's folder for what exceeds its memory; empty where the rows are bounded."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"SET memory_limit = '{MEMORY}'")
    con.execute("SET preserve_insertion_order = false")
    con.execute(f"SET temp_directory = '{spill}'")
    con.register("input_rows", rows)
    out = con.sql("SELECT field_name, term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM input_rows GROUP BY field_name, term").to_arrow_table()
    con.close()
    return out.combine_chunks().to_batches()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums within the task, at most ``COMBINE_ROWS`` rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= COMBINE_ROWS:
            yield from _aggregate(pa.Table.from_batches(held), "")
            held, n = [], 0
    if held:
        yield from _aggregate(pa.Table.from_batches(held), "")


def _aggregator(tasks: list[list[str]]):
    """Task k aggregates the partitions of ``tasks[k]``, folder by folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        for b in batches:
            for folder in (x for k in b.column(0).to_pylist() for x in tasks[k]):
                files, path = fs.FileSystem.from_uri(folder)
                rows = dataset.dataset(path, filesystem=files, format="parquet").scanner(columns=["field_name", "term", "occurrences", "records"]).to_reader()
                # a folder that isn't mounted can't hold DuckDB's spill: the partition's size alone bounds memory there
                spill = f"{path}/_spill-{uuid.uuid4().hex}" if isinstance(files, fs.LocalFileSystem) else ""
                yield from _aggregate(rows, spill)
                if spill:
                    shutil.rmtree(spill, ignore_errors=True)

    return run


def radix_partitions(rows: DataFrame, path: str, bits: int, partition_rows: int) -> list[str]:
    """The folders of the partitions of (..., h), none with more than ``partition_rows`` rows of different hashes."""
    spark, schema = rows.sparkSession, rows.withColumn("leaf", F.lit(0).cast("long")).schema
    folders, level = [], 0
    while True:
        at = f"{path}/level={level}"
        rows.withColumn("leaf", F.shiftrightunsigned("h", 64 - bits)).repartition("leaf").write.partitionBy("leaf").parquet(at)
        written = spark.read.schema(schema).parquet(at)
        sizes = written.groupBy("leaf").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()  # a row a partition
        over = [r["leaf"] for r in sizes if r["n"] > partition_rows and r["lo"] < r["hi"] and bits + NEXT_BITS <= 60]
        folders += [f"{at}/leaf={r['leaf']}" for r in sorted(sizes, key=lambda r: -r["n"]) if r["leaf"] not in over]
        if not over:
            return folders
        rows, bits, level = written.where(F.col("leaf").isin(over)).drop("leaf"), bits + NEXT_BITS, level + 1


def term_counts(lists: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(field_name, term, occurrences, records) of every term of (field_name, items array)."""
    spark = lists.sparkSession
    one = record_terms(lists).withColumn("records", F.lit(1).cast("long"))
    combined = one.mapInArrow(_combine, _COMBINED).withColumn("h", F.xxhash64("field_name", "term"))
    # a few partitions for each task of the shuffle, however large the cluster is
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "terms")
    folders = radix_partitions(combined, path, max(FIRST_BITS, (4 * width - 1).bit_length()), partition_rows)
    if not folders:
        drop_path(spark, path)
        return spark.createDataFrame([], _COMBINED)
    n = min(len(folders), max(width, len(folders) // 16))
    counted = materialise(spark.range(0, n, 1, n).mapInArrow(_aggregator([folders[k::n] for k in range(n)]), _COMBINED))
    drop_path(spark, path)
    return counted


def marked_terms(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ``mark``: rare, common or null. ``totals``: (field_name, rows), all rows of the field's table."""
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > COMMON_ABOVE * F.col("rows"), "common")
    return counts.join(F.broadcast(totals), "field_name").withColumn("mark", mark).drop("rows")  # totals: a row a field
