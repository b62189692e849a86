"""Packing items of varying length into containers of fixed capacity (problem 8).

Method: shortest-pack-first over the length histogram. Only the histogram, at most ``capacity``
rows, comes to the driver. Lengths are placed longest first; a length goes to the open patterns with
the most room (the shortest packs), as many packs at a time as the pattern has or the length needs,
and patterns' counts are split as they are used. A pack is opened only where no open one has room.
The patterns are then joined back to the items by their rank within their length.

Ranks don't sort a length in one task: each length is cut into hash groups whose number follows the
number of items, ranked in the group, and shifted by the running total of the groups before.

An item above the capacity fills containers of its own and its rest is packed as an item.

Defined results: items without tokens (null, empty texts) get no container; repeated rows are
packed each; ties between items of one length are broken by id, and by position in the hash group;
an empty table gives no rows; other columns are not carried along.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CAPACITY = 2048
GROUP_ROWS = 50_000

Pattern = dict[int, int]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(number of containers, {length: times}) for each pattern; every item of the histogram is placed."""
    open_: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    done: list[tuple[int, Pattern]] = []

    def put(room: int, count: int, pattern: Pattern) -> None:
        if count:
            (open_[room] if room else done).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, x in open_.items() if x), default=0)
            if room < length:
                times = capacity // length
                full, rest = divmod(left, times)
                put(capacity - times * length, full, {length: times})
                put(capacity - rest * length, int(rest > 0), {length: rest})
                break
            count, pattern = open_[room].pop()
            used = min(count, left)
            put(room, count - used, pattern)
            put(room - length, used, pattern | {length: pattern.get(length, 0) + 1})
            left -= used
    return [*done, *(x for group in open_.values() for x in group)]


def _slots(patterns: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first container, times, offset) of each length in each pattern."""
    rows, taken, base = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            times = pattern[length]
            rows.append((length, taken[length], taken[length] + count * times, base, times, offset))
            taken[length] += count * times
            offset += length * times
        base += count
    return rows


def ranked_by_length(items: DataFrame, total: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``rank``, dense from 0 within each ``n_tokens``, without one task per length."""
    groups = max(1, -(-total // group_rows))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("n_tokens", "salt", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part")) - 1
    return salted.withColumn("local", local).join(before, ["n_tokens", "salt"]).withColumn("rank", F.col("before") + F.col("local")).drop("salt", "local", "before")


def pack_items(sizes: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(container_id, doc_id, part, start, n_tokens, place): each piece of each item in its container.

    ``sizes`` holds (doc_id, n_tokens). ``start`` is where the piece begins in its item, ``place``
    where it lies in the container, both in tokens.
    """
    spark = sizes.sparkSession
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)).alias("part")
    items = sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("of"), parts)
    start = F.col("part").cast("long") * capacity
    items = materialise(items.select("doc_id", "part", start.alias("start"), F.least(F.lit(capacity), F.col("of") - start).cast("int").alias("n_tokens")))
    histogram = {r["n_tokens"]: r["count"] for r in items.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    total = sum(histogram.values())
    schema = "n_tokens int, lo long, hi long, base long, times int, offset int"
    # its size follows the number of lengths and patterns, not the number of items
    slots = F.broadcast(spark.createDataFrame(_slots(pack_histogram(histogram, capacity)), schema))
    nth = F.col("rank") - F.col("lo")
    return (
        ranked_by_length(items, total, group_rows)
        .join(slots, "n_tokens")
        .where("rank >= lo AND rank < hi")
        .select(
            (F.col("base") + F.floor(nth / F.col("times"))).cast("long").alias("container_id"),
            "doc_id",
            "part",
            "start",
            "n_tokens",
            (F.col("offset") + F.pmod(nth, F.col("times")) * F.col("n_tokens")).cast("int").alias("place"),
        )
    )
