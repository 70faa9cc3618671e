"""Document fingerprints by order MinHash (operator 8).

A text's k-mers of code points are numbered by occurrence, so that each (k-mer, number) is
unique. For each of ``entries`` hash functions the ``pick`` smallest are selected, put back into
text order, and their k-mers hashed as a tuple. Two texts share an entry if they share
both the k-mers and their order, so the share of equal entries follows edit distance
and not only the set of k-mers.

A null text is empty; a text shorter than ``k`` is one k-mer; the empty text has none and
a fingerprint of its own. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

K, PICK, ENTRIES = 6, 2, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _seeds(entries: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    flips = rng.integers(0, 1 << 63, entries, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, entries, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return flips[:, None], odd[:, None]


_SEEDS = {ENTRIES: _seeds(ENTRIES)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def signature(text: str, k: int = K, pick: int = PICK, entries: int = ENTRIES) -> np.ndarray:
    """``entries`` hashes of 32 bits."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(len(points) - k + 1, min(len(points), 1))
    width = min(k, len(points))
    grams = np.zeros(n, np.uint64)
    for i in range(width):
        grams = grams * _BASE + points[i:i + n]
    if not n:
        return np.zeros(entries, np.uint32)
    # Sort (top bits of the hash, position) as one number; equal k-mers become neighbours in text order.
    bits = np.uint64(max(n - 1, 1).bit_length())
    place = np.arange(n, dtype=np.uint64)
    both = np.sort((_mixed(grams) >> bits << bits) | place)
    key, place = both >> bits, both & ((np.uint64(1) << bits) - np.uint64(1))
    count = np.arange(n)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    count = count - np.maximum.accumulate(np.where(fresh, count, 0))
    unique = _mixed(key * _BASE + count.astype(np.uint64))
    flips, odd = _SEEDS.get(entries) or _seeds(entries)
    rank = (unique[None, :] ^ flips) * odd
    take = min(pick, n)
    if n > 64:
        # The smallest few lie below this with near certainty; if not, all are sorted.
        entry, column = np.nonzero(rank < np.uint64(int((1 << 64) * 8.0 * take / n) - 1) if 8 * take < n else rank >= 0)
        if np.bincount(entry, minlength=entries).min() < take:
            entry, column = np.nonzero(rank >= 0)
    else:
        entry, column = np.nonzero(rank >= 0)
    order = np.lexsort((rank[entry, column], entry))
    entry, column = entry[order], column[order]
    first = np.searchsorted(entry, np.arange(entries))
    chosen = column[first[:, None] + np.arange(take)]
    chosen = np.take_along_axis(chosen, np.argsort(place[chosen], axis=1), axis=1)
    out = np.zeros(entries, np.uint64)
    for i in range(take):
        out = _mixed(out * _BASE + key[chosen[:, i]] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal entries."""
    return float((one == other).mean())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches):
        for batch in batches:
            prints = [written(signature(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())],
                                             names=["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(made, f"doc_id {kind}, fingerprint string")


def _splitters(keyed: DataFrame, n_ranges: int) -> list[tuple[int | str, int]]:
    """Keys of real rows, falling, that cut the bytes into about ``n_ranges`` parts; the first is the largest key."""
    total = keyed.agg(F.sum("size").alias("n"), F.max(F.struct("key", "tie")).alias("top")).first()
    if total["top"] is None:
        return []
    wanted = 24 * n_ranges
    uniform = F.pmod(F.xxhash64("key", "tie", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keyed.filter(F.col("size") * F.lit(wanted / total["n"]) > uniform).select("key", "tie", "size").collect()
    rows = sorted(((r["key"], r["tie"], max(r["size"], total["n"] // wanted)) for r in drawn), reverse=True)
    step, at, out = sum(r[2] for r in rows) / n_ranges, 0.0, [tuple(total["top"])]
    for key, tie, weight in rows:
        at += weight
        if at >= step * len(out) and (key, tie) < out[-1]:
            out.append((key, tie))
    return out


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Documents stand in falling id (integers by value, ids of any other type by their text; null ids
    last; equal ids by a hash of the text); the
    edited text's last half is the beginning of the next document, the first following the last.
    Rows are range-partitioned in that order at the keys of sampled rows; the row at a
    key also goes, marked, to the range before, whose last document it follows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    # A mark before the text of an id lets a null stand below the empty text.
    key = (F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")) if whole
           else F.coalesce(F.concat(F.lit("#"), F.col(id_col).cast("string")), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("tie"))
    sizes = keyed.select("key", "tie", (F.octet_length("text") + 16).alias("size"))
    spark = docs.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keyed.rdd.getNumPartitions())
    cuts = _splitters(sizes, 4 * n_parts)

    @F.pandas_udf("array<int>")
    def ranges(key: pd.Series, tie: pd.Series) -> pd.Series:
        # The range of a row; for a row that opens a range, also the range before, as -1 - range.
        opens = {c: i for i, c in enumerate(cuts)}
        kind = np.int64 if whole else object
        rising = np.array([c[0] for c in reversed(cuts)], kind)
        above = len(cuts) - np.searchsorted(rising, key.to_numpy(kind), "right")
        out = []
        for at, k, t in zip(above.tolist(), key.tolist(), tie.tolist()):
            while at < len(cuts) and cuts[at] >= (k, t):
                at += 1
            opened = opens.get((k, t))
            out.append([at - 1] if opened is None else [at - 1, -1 - (opened - 1) % len(cuts)])
        return pd.Series(out)

    dealt = keyed.withColumn("part", F.explode(ranges("key", "tie")))
    dealt = dealt.select("doc_id", "text", "key", "tie", (F.col("part") < 0).alias("follows"),
                         F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")).alias("part"))
    ordered = dealt.repartition(n_parts, "part").sortWithinPartitions(
        "part", "follows", F.col("key").desc(), F.col("tie").desc())

    def made(batches):
        held = None  # part, id, text, signature
        for batch in batches:
            rows = []
            for doc_id, own, follows, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "follows", "part"))):
                if follows and (held is None or held[0] != part):
                    continue  # a further copy of the row that follows
                print_ = signature(own)
                if held is not None:
                    rows.append(_compared(held, own, print_))
                held = None if follows else (part, doc_id, own, print_)
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3,
                                                           pa.float64(), pa.float64()])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ordered.select("doc_id", "text", "follows", "part").mapInArrow(
        made, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")


def _compared(held, following: str, following_print: np.ndarray) -> tuple:
    _, doc_id, text, own = held
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    changed = signature(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed),
            likeness(own, changed), likeness(own, following_print))
