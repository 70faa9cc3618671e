"""Size-balanced shards by sampled splitters (operator 3).

Records are ordered by a hash of their text, so equal texts are neighbours, then by id.
Samples of the keys, each drawn with a chance in proportion to the record's size, give
quantile boundaries of many more ranges than shards; records are partitioned into these
ranges, and ranges that come out overfull are divided by samples of their own until none is. A
text so frequent that it fills several ranges is divided among them by id. Within a range,
running sums give each record its exact place in the bytes of the whole table (offsets
of the ranges come from one small aggregation), and shard i takes the records whose
middle lies in the i-th share of the bytes.

A group of equal texts stays in one shard if it holds at most ``whole`` of a shard's bytes;
a larger one is divided between records. Only ids, sizes and hashes are shuffled.

Null texts have the size of empty ones. Null ids come first; rows that agree in id and
text are ordered by their place in the input.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import Scratch

#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("key"),
        F.xxhash64(F.col(id_col).cast("string")).alias("tie"),
        F.monotonically_increasing_id().alias("row"))


def _sample(records: DataFrame, wanted: int, total: int, by_size: bool = True, salt: int = 17) -> list[tuple[int, int, int]]:
    """About ``wanted`` keys, each with a chance in proportion to its size (or all alike); large records may come twice."""
    chance = (F.col("size") if by_size else F.lit(1)) * F.lit(wanted / max(total, 1))
    uniform = F.pmod(F.xxhash64("key", "tie", "row", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = (records.select("key", "tie", "row", F.floor(chance + uniform).cast("int").alias("times"))
             .filter("times > 0").collect())
    return sorted((r["key"], r["tie"], r["row"]) for r in drawn for _ in range(r["times"]))


def boundaries(sample: list[tuple[int, int, int]], n_ranges: int) -> list[tuple[int, int, int]]:
    """Quantiles of the sample; one that cuts a text for the first time moves to where that text begins."""
    if not sample:
        return []
    cuts = [sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)]
    least = -(1 << 63)
    found: set[tuple[int, int, int]] = set()
    for cut in cuts:
        start = (cut[0], least, least)
        found.add(cut if start in found else start)
    return sorted(found)


def range_of(key: np.ndarray, tie: np.ndarray, row: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """How many cuts are not above each record's (key, tie, row)."""
    firsts = np.array([c[0] for c in cuts], np.int64)
    low, high = np.searchsorted(firsts, key, "left"), np.searchsorted(firsts, key, "right")
    for i in np.flatnonzero(high - low > 0):
        low[i] = bisect_right(cuts, (int(key[i]), int(tie[i]), int(row[i])), int(low[i]), int(high[i]))
    return low


def _with_range(records: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    def placed(batches):
        for batch in batches:
            key, tie, row = (batch.column(c).to_numpy() for c in ("key", "tie", "row"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_of(key, tie, row, cuts), pa.int32())],
                                             names=[*batch.schema.names, "range_id"])

    kinds = ", ".join(f"{n} {k}" for n, k in records.dtypes)
    return records.mapInArrow(placed, f"{kinds}, range_id int")


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          ranges_per_shard: int = 32, samples_per_range: int = 24, whole: float = 0.01) -> DataFrame:
    """One row per record: size, checksum, shard and gapless place in the shard."""
    scratch = Scratch(docs.sparkSession, "shards")
    records = scratch.store(_records(docs, id_col, text_col), "records")
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    n_ranges = n_shards * ranges_per_shard
    cuts = boundaries(_sample(records, n_ranges * samples_per_range, total), n_ranges)
    again, by_size = 0, True
    while True:
        placed = _with_range(records, cuts)
        # At most one row for each range, whatever the size of the table.
        sums = {r["range_id"]: (r["bytes"], r["n"]) for r in placed.groupBy("range_id").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        full = [k for k, (b, n) in sums.items() if n > 4 * samples_per_range and b > 3 * total / n_ranges]
        if not full:
            break
        inside = placed.filter(F.col("range_id").isin(full))
        part = sum(sums[k][0 if by_size else 1] for k in full)
        extra = _sample(inside, 8 * samples_per_range * len(full) * 2 ** min(again, 3), part, by_size, 17 + again)
        finer = sorted({*cuts, *boundaries(extra, 8 * len(full))})
        # Without a new cut a large record has drawn them all; then all records have the same chance.
        cuts, again, by_size = finer, again + 1, finer != cuts
    starts, at_byte, at_row = {}, 0, 0
    for k in sorted(sums):
        starts[k] = (at_byte, at_row)
        at_byte, at_row = at_byte + sums[k][0], at_row + sums[k][1]
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(k, *v) for k, v in starts.items()], "range_id int, byte0 long, row0 long")
    hot = sorted({b[0] for a, b in zip(cuts, cuts[1:]) if a[0] == b[0]})
    frequent = spark.createDataFrame([(k,) for k in hot], "key long").withColumn("frequent", F.lit(True))

    ordered = Window.partitionBy("range_id").orderBy("key", "tie", "row")
    group = Window.partitionBy("range_id", "key")
    exact = (placed.repartition("range_id")
             .withColumn("before", F.sum("size").over(ordered) - F.col("size"))
             .withColumn("nth", F.row_number().over(ordered) - 1)
             .withColumn("group_bytes", F.sum("size").over(group))
             .withColumn("group_before", F.min("before").over(group))
             # Both tables are bounded by the number of ranges.
             .join(F.broadcast(offsets), "range_id").join(F.broadcast(frequent), "key", "left"))
    divide = F.col("frequent").isNotNull() | (F.col("group_bytes") > whole * total / n_shards)
    # Twice the middle of the record, or of its group: a cut is off by half a record at most.
    middle = 2 * F.col("byte0") + F.when(divide, 2 * F.col("before") + F.col("size")).otherwise(
        2 * F.col("group_before") + F.col("group_bytes"))
    exact = exact.select(
        "doc_id", "size", "text_crc32", (F.col("row0") + F.col("nth")).alias("place"),
        F.least(F.lit(n_shards - 1), F.floor(middle / F.lit(2.0 * max(total, 1)) * n_shards)
                ).cast("int").alias("shard"))
    exact = scratch.store(exact, "places")
    scratch.drop("records")
    first = exact.groupBy("shard").agg(F.min("place").alias("first"))
    return exact.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
