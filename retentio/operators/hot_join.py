"""Join of rows to a table with one row for each key, when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: At most so many keys count as heavy; their list goes to the driver and to every task.
MOST_HEAVY = 10_000
#: A key of fewer rows is never heavy.
LEAST_ROWS = 100


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "left",
             most_heavy: int = MOST_HEAVY) -> DataFrame:
    """``rows`` with the other columns of ``table``, whose keys ``on`` are unique; null equals null.

    A key that holds more than one in ``most_heavy`` of all rows is heavy, so there are at most
    that many. The rows of a heavy key are dealt by the hash of ``spread`` to as many copies of
    its row in ``table`` as it takes to keep each below that share (all copies together: at most
    twice ``most_heavy`` rows). ``rows`` is read three times: give a stored table.
    """
    piece = max(LEAST_ROWS, rows.count() // most_heavy)
    tally = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > piece)
    heavy = tally.select(*on, F.ceil(F.col("_n") / piece).cast("int").alias("_copies")).collect()
    named = table.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(on)], *[c for c in table.columns if c not in on])
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    if not heavy:
        return rows.join(named, same, how).drop(*[f"_key{i}" for i in range(len(on))])
    fields = [StructField(f"_hot{i}", rows.schema[k].dataType) for i, k in enumerate(on)]
    listed = rows.sparkSession.createDataFrame([tuple(r) for r in heavy], StructType([*fields, StructField("_copies", IntegerType())]))
    hot = [f"_hot{i}" for i in range(len(on))]

    def marked(df: DataFrame, names: list[str]) -> DataFrame:
        match = F.lit(True)
        for name, h in zip(names, hot):
            match = match & F.col(name).eqNullSafe(F.col(h))
        return df.join(F.broadcast(listed), match, "left").drop(*hot)

    dealt = marked(rows, on).withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_copies")), F.lit(0)).cast("int")).drop("_copies")
    copies = marked(named, [f"_key{i}" for i in range(len(on))]).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))).drop("_copies")
    joined = dealt.join(copies, same & (F.col("_part") == F.col("_copy")), how)
    return joined.drop("_part", "_copy", *[f"_key{i}" for i in range(len(on))])
