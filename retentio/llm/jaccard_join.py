"""Similarity classes of documents by a size-aware heavy-light Jaccard join (operator 6).

A document's set holds the 64-bit hashes of its distinct word shingles; documents of equal
sets are one from then on (``sid`` is a hash of the set). All sets order their shingles alike:
shingles found often (counted by chunk over all texts) come last. If two sets reach the
threshold, then among the first ``n - ceil(t n) + c`` shingles of each at least c are shared.

* Light sets (up to a boundary size) enumerate all 2-subsets of that prefix (c = 2): two
  light sets that link share one of these keys.
* Heavy sets, and light ones near the boundary, post each shingle of the prefix (c = 1) to
  inverted lists, which are scanned for partners.

The boundary has the least estimated cost, from the histogram of set sizes.

Only connectivity is asked for, so a list is not expanded into all pairs. Each list first
compares its members with one pivot, its most typical set (the one with the fewest rare
shingles); candidates whose sketches (counts by bucket, an upper bound of the overlap) rule
a link out are dropped, the others joined into components; then only lists that still
hold members of different components are compared further: every pair of different
components within the size and position limits. Where verification splits a component,
its parts are compared in the same way: first a few sets of each part, which join most parts of one
class, then all pairs of the parts still apart. No link between different components is lost.
Lists of frequent keys are divided among tasks, and the parts' pivots are compared among each other. Candidates are verified on whole sets, which only
documents in candidate pairs send (a bitmap of fixed size tells which).

A null text has no words: size 0, its own component. Null ids count as the largest id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, arrow_batches, kept
from retentio.llm.components import connected_components

#: Frequent shingles that are sent to all tasks for the order of prefixes, at most.
MAX_COMMON = 1 << 18
#: Shingles after which a task passes on its counts, and the least count that it passes on.
CHUNK, LEAST_COUNT = 4_000_000, 2
#: Members of a list that one task scans; longer lists are divided.
LIST_PART = 2048
#: Sets of each component of a list that are compared before all of them are.
FEW = 16
#: Buckets of a set's sketch.
SKETCH = 256
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Per text, its distinct shingle hashes, rising; a text of fewer words is one shingle."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    offsets = offsets - offsets[0]
    if not len(flat):
        return [np.zeros(0, np.uint64)] * len(text)
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    empty = np.array([not w for w in coded.dictionary.to_pylist()], bool)
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = ~empty[code]
    before = np.concatenate([[0], np.cumsum(real)])
    offsets, hashes = before[offsets], names[code[real]]
    n = max(len(hashes) - width + 1, 0)
    rolled = np.full(n, np.uint64(width))
    for i in range(width):
        rolled = rolled * _P + hashes[i:i + n]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a:b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.full(1, np.uint64(b - a))
            for h in hashes[a:b]:
                whole = whole * _P + h
            out.append(_mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(own: np.ndarray) -> int:
    """Signed 64-bit identity of a set; equal sets agree whatever order they were built in."""
    total = np.add.reduce(_mix(own + _P), keepdims=True) + np.full(1, len(own), np.uint64) * _M
    return int(_mix(total).view(np.int64)[0])


def needed(n: int, percent: int) -> int:
    """Smallest overlap of a set of n shingles with any set that it links with."""
    return -(-percent * n // 100)


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall into each of ``SKETCH`` buckets; empty if one holds too many to write."""
    counts = np.bincount((own >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _sets_pass(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's id, size and sketch; besides, counts of shingles that a chunk of texts repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "tkey", "sid", "n", "is_count", "sketch"]

    def passed(batches):
        kept("jaccard")
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def counts(id_type, key_type):
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = n >= LEAST_COUNT
            m = int(keep.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, id_type), pa.nulls(m, key_type), pa.array(values[keep].view(np.int64)),
                 pa.array(n[keep].astype(np.int32)), pa.array(np.ones(m, bool)), pa.nulls(m, pa.binary())], names=names)

        types = None
        for batch in batches:
            types = batch.schema.field("doc_id").type, batch.schema.field("tkey").type
            sets = shingle_sets(batch.column("text"), width)
            ids = [set_id(s) if len(s) else None for s in sets]
            for own, sid in zip(sets, ids):
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    held.append(own)
                    size += len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(ids, pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()), pa.array(np.zeros(len(ids), bool)),
                 pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], names=names)
            if size >= CHUNK:
                yield counts(*types)
                held, size, seen = [], 0, set()
        if types:
            yield counts(*types)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).mapInArrow(
        passed, f"doc_id {kind}, tkey long, sid long, n int, is_count boolean, sketch binary")


def choose_boundary(sizes: dict[int, int], percent: int, list_cost: float = 4.0) -> int:
    """Largest size of light sets: least cost of enumerated subsets plus scanned postings."""
    def subsets(n):
        m = n - needed(n, percent) + 2
        return m * (m - 1) // 2 if n > 1 else 0

    def postings(n):
        return list_cost * (n - needed(n, percent) + 1)

    order = sorted(sizes)
    best, best_cost = 1, math.inf
    for x in [1, *(n for n in order if n <= 200)]:
        cost = sum(c * subsets(n) for n, c in sizes.items() if n <= x)
        cost += sum(c * postings(n) for n, c in sizes.items() if n >= needed(x + 1, percent))
        if cost < best_cost:
            best, best_cost = x, cost
    return best


def ordered(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles in the order all sets share (rare first), and their counts (0: not frequent)."""
    if not len(common):
        return own, np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    count = np.where(common[at] == own, counts[at], 0)
    order = np.lexsort((own, count))
    return own[order], count[order]


def keys_of(own: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int, boundary: int):
    """Keys of a set: (key, count of the rarest shingle in it, most overlap from there on)."""
    n = len(own)
    if n < 2:
        return None
    shingles, count = ordered(own, common, counts)
    parts = []
    if n <= boundary:
        m = n - needed(n, percent) + 2
        i, j = np.triu_indices(m, 1)
        parts.append((_mix(shingles[i] * _P + shingles[j]), count[i], n - j + 1))
    if n >= needed(boundary + 1, percent):
        m = n - needed(n, percent) + 1
        parts.append((shingles[:m], count[:m], n - np.arange(m)))
    key, count_, most = (np.concatenate(x) for x in zip(*parts))
    return key, count_, most, int((count == 0).sum())


def _postings(docs: DataFrame, common_sent, percent: int, boundary: int, width: int) -> DataFrame:
    """(key, part, sid, n, most, rare): part divides lists of frequent keys, -1 where there is one part."""
    names = ["key", "part", "sid", "n", "most", "rare"]

    def posted(batches):
        kept("jaccard")
        common, counts = common_sent.value
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for own in shingle_sets(batch.column("text"), width):
                if len(own) < 2 or (sid := set_id(own)) in seen:
                    continue
                seen.add(sid)
                key, count, most, rare = keys_of(own, common, counts, percent, boundary)
                parts = -(-count // LIST_PART)
                part = np.where(parts > 1, (sid & 0x7FFFFFFF) % np.maximum(parts, 1), -1)
                rows.append((key.view(np.int64), part, np.full(len(key), sid), np.full(len(key), len(own)), most,
                             np.full(len(key), rare)))
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                columns = [np.concatenate(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k in (0, 2) else pa.int32()) for k, c in enumerate(columns)], names=names)

    return docs.select("text").mapInArrow(posted, "key long, part int, sid long, n int, most int, rare int")


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Overlap from which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def _lists(postings: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """Of every key with several sets: its members, and its part's pivot (a pair where the limits allow one)."""
    names = ["key", "part", "sid", "n", "most", "rare", "pivot", "paired"]

    def listed(batches):
        kept("jaccard")
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        table = pa.concat_tables(held)
        key, part, sid, n, most, rare = (table.column(c).to_numpy() for c in names[:6])
        order = np.lexsort((sid, part, key))
        key, part, sid, n, most, rare = (x[order] for x in (key, part, sid, n, most, rare))
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        keep = ~(again & np.concatenate([[False], sid[1:] == sid[:-1]]))  # a set comes once from each task
        key, part, sid, n, most, rare, again = (x[keep] for x in (key, part, sid, n, most, rare, again))
        group = np.cumsum(~again) - 1
        several = np.bincount(group)[group] > 1
        keep = several | (part >= 0)
        if not keep.any():
            return
        key, part, sid, n, most, rare, group = (x[keep] for x in (key, part, sid, n, most, rare, group))
        order = np.lexsort((sid, rare, group))
        key, part, sid, n, most, rare, group = (x[order] for x in (key, part, sid, n, most, rare, group))
        first = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        paired = ~first & (np.minimum(most, most[at]) >= least_overlap(n, n[at], percent))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (key, part, sid, n, most, rare, sid[at], paired)], names=names)

    kinds = "key long, part int, sid long, n int, most int, rare int, pivot long, paired boolean"
    return postings.repartition(n_parts, "key", "part").mapInArrow(listed, kinds)


def _pairs(a, b) -> tuple:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _bitmap(sids: DataFrame, bits: int):
    """A bitmap of hashed ids; its size is set by ``bits`` alone."""
    page = 15

    def marked(batches):
        kept("jaccard")
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = _slot(batch.column("sid").to_numpy(), bits)
            for p in np.unique(slot >> page).tolist():
                own = pages.setdefault(p, np.zeros(1 << page, bool))
                own[slot[slot >> page == p] & ((1 << page) - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(pages), pa.int64()), pa.array([np.packbits(v).tobytes() for v in pages.values()], pa.binary())],
            names=["page", "bits"])

    def merged(key, table):
        total = np.zeros((1 << page) // 8, np.uint8)
        for value in table.column("bits").to_pylist():
            total |= np.frombuffer(value, np.uint8)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([total.tobytes()], pa.binary())})

    rows = (sids.mapInArrow(marked, "page long, bits binary").groupBy("page")
            .applyInArrow(merged, "page long, bits binary").collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        out[row["page"] << (page - 3):(row["page"] + 1) << (page - 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _slot(sid: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(sid.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _members(docs: DataFrame, bitmap_sent, bits: int, width: int) -> DataFrame:
    """(sid, shingles) of the sets that the bitmap holds; once from each task."""
    def found(batches):
        kept("jaccard")
        marks = bitmap_sent.value
        seen: set[int] = set()
        for batch in batches:
            rows = {}
            for own in shingle_sets(batch.column("text"), width):
                if len(own):
                    sid = set_id(own)
                    slot = int(_slot(np.array([sid]), bits)[0])
                    if sid not in seen and marks[slot >> 3] & (128 >> (slot & 7)):
                        seen.add(sid)
                        rows[sid] = own
            if rows:
                ends = np.concatenate([[0], np.cumsum([len(v) for v in rows.values()])]).astype(np.int32)
                flat = np.concatenate(list(rows.values())).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["sid", "shingles"])

    return docs.select("text").mapInArrow(found, "sid long, shingles array<long>")


def _marks(scratch: Scratch, pairs: DataFrame, label: str):
    """A bitmap of the sets in ``pairs`` (sent to the tasks), and its size as a power of two."""
    spark = pairs.sparkSession
    sids = scratch.store(pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct(), f"{label}-sids")
    bits = min(30, max(20, (16 * sids.count()).bit_length()))
    with arrow_batches(spark, 100_000):
        return spark.sparkContext.broadcast(_bitmap(sids, bits)), bits


def _holding(table: DataFrame, marks, bits: int) -> DataFrame:
    """The rows of ``table`` whose ``sid`` the bitmap holds, before anything is shuffled."""
    @F.pandas_udf("boolean")
    def held(sid: pd.Series) -> pd.Series:
        slot = _slot(sid.to_numpy(np.int64), bits)
        return pd.Series(marks.value[slot >> 3] & (128 >> (slot & 7)) > 0)

    return table.filter(held("sid"))


def _possible(scratch: Scratch, pairs: DataFrame, sketches: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (u, v) whose sketches allow the overlap that a link needs."""
    def allowed(batches):
        kept("jaccard")
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            open_ = np.array([not (x and y) for x, y in zip(a, b)], bool)
            if len(open_) and not open_.all():
                one, two = (np.frombuffer(b"".join(x for x, o in zip(c, open_) if not o), np.uint8).reshape(-1, SKETCH)
                            for c in (a, b))
                most = np.minimum(one, two).sum(axis=1, dtype=np.int64)
                sizes = (batch.column(c).to_numpy()[~open_].astype(np.int64) for c in ("m", "n"))
                open_[~open_] = most >= least_overlap(*sizes, percent)
            yield batch.select(["u", "v"]).filter(pa.array(open_))

    near = _holding(sketches, *_marks(scratch, pairs, label)).dropDuplicates(["sid"])
    left = near.select(F.col("sid").alias("u"), F.col("n").alias("m"), F.col("sketch").alias("a"))
    right = near.select(F.col("sid").alias("v"), "n", F.col("sketch").alias("b"))
    return pairs.join(right, "v").join(left, "u").mapInArrow(allowed, "u long, v long")


def _verified(scratch: Scratch, pairs: DataFrame, members: DataFrame, percent: int, label: str, spread: int = 16) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the threshold."""
    # A pivot has many pairs: they are spread, and its set is sent to each part that has one.
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(spread)))
    left = (dealt.select("u", "part").distinct()
            .join(members.select(F.col("sid").alias("u"), F.col("shingles").alias("a")), "u"))
    right = dealt.join(members.select(F.col("sid").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    links = right.join(left, ["u", "part"]).filter(
        100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")
    return scratch.store(links, f"{label}-links")


def _crossing(scratch: Scratch, lists: DataFrame, labels: DataFrame, percent: int, label: str, few: int | None = None) -> DataFrame:
    """Pairs of a list that are in different components, within the size and position limits.

    Lists of the same members are one; lists within one component are left out before any pair is made.
    With ``few``, so many sets of each component of a list are paired: the most typical, as with pivots.
    """
    tagged = (lists.select("key", "sid", "n", "most", "rare")
              .join(labels.withColumnRenamed("node", "sid"), "sid", "left")
              .withColumn("component", F.coalesce("component", "sid")))
    open_ = (tagged.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("sid")).alias("members")).filter("low != high"))
    mixed = (tagged.join(open_.select("key", F.xxhash64("size", "members").alias("list")), "key")
             .groupBy("list", "sid").agg(F.max("most").alias("most"), F.first("n").alias("n"), F.first("rare").alias("rare"),
                                         F.first("component").alias("component")))
    if few:
        nth = F.row_number().over(Window.partitionBy("list", "component").orderBy("rare", "sid"))
        mixed = mixed.withColumn("nth", nth).filter(F.col("nth") <= few).drop("nth")
    mixed = scratch.store(mixed, f"{label}-mixed")
    one, two = mixed.alias("one"), mixed.alias("two")
    limit = F.ceil(percent * (F.col("one.n") + F.col("two.n")) / (100.0 + percent) - 1e-9)
    return (one.join(two, F.col("one.list") == F.col("two.list"))
            .filter((F.col("one.sid") < F.col("two.sid")) & (F.col("one.component") != F.col("two.component"))
                    & (F.least("one.most", "two.most") >= limit))
            .select(F.col("one.sid").alias("u"), F.col("two.sid").alias("v")).distinct())


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The components (node, component) after further links: only the components that these join are gone through."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    edges = (links.join(of("u"), "u", "left").join(of("v"), "v", "left")
             .select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")).distinct())
    joined = connected_components(scratch, edges, label)
    moved = (labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
             .select("node", F.coalesce("to", "component").alias("component")))
    # A set without a component so far is a node of the joined ones itself.
    return scratch.store(moved.unionByName(joined.join(labels, "node", "left_anti")), f"{label}-labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
            ) -> tuple[DataFrame, Scratch]:
    """(doc_id, tkey, n, component) for every row: hash of the text, set size, smallest id of its class.

    ``component`` is the row's own id where nothing links. Two rows link at a Jaccard
    similarity of ``percent`` hundredths or more.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = scratch.store(_sets_pass(docs, width), "sets")
    rows = both.filter(~F.col("is_count"))
    # Bounded by MAX_COMMON; only the order of prefixes depends on it, not the result.
    common = (both.filter("is_count").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") > LEAST_COUNT)
              .orderBy(F.desc("n"), "sid").limit(MAX_COMMON).toPandas())
    values = common["sid"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    sent = spark.sparkContext.broadcast((values[order], common["n"].to_numpy(np.int64)[order]))
    # At most 1000 rows.
    sizes = {r["n"]: r["c"] for r in rows.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("c")).collect()}
    boundary = choose_boundary({n: c for n, c in sizes.items() if n}, percent)

    # A document's postings take about as many bytes as its text: as many partitions as the input has.
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    lists = _lists(_postings(docs, sent, percent, boundary, width), percent, n_parts)
    lists = scratch.store(lists, "lists")
    # Pivots of the parts of divided lists meet in a list of pivots.
    heads = lists.filter("part >= 0 and sid = pivot").withColumn("part", F.lit(-1))
    with arrow_batches(spark, 100_000):
        joint = scratch.store(_lists(heads.select("key", "part", "sid", "n", "most", "rare"), percent, n_parts), "joint")
    stars = lists.unionByName(joint).filter("paired")
    # First the pivots' pairs; the components they would make, if all that the sketches allow
    # were links, leave few pairs to compare besides.
    sketches = rows.filter("sid is not null").select("sid", "n", "sketch")
    pairs = scratch.store(stars.select(*_pairs(F.col("pivot"), F.col("sid"))).distinct(), "pairs")
    near = scratch.store(_possible(scratch, pairs, sketches, percent, "near"), "near")
    tentative = connected_components(scratch, near, "tentative")
    across = scratch.store(_crossing(scratch, lists, tentative, percent, "across").join(pairs, ["u", "v"], "left_anti"), "across")
    candidates = scratch.store(near.unionByName(_possible(scratch, across, sketches, percent, "across")), "candidates")
    marks = _marks(scratch, candidates, "candidates")
    members = scratch.store(_members(docs, *marks, width).dropDuplicates(["sid"]), "members")
    links = _verified(scratch, candidates, members, percent, "first")
    labels = connected_components(scratch, links, "linked")
    # Where a pair was no link after all, its component may have fallen apart: compare the parts.
    # All their sets are at hand, as each belongs to a candidate pair. A few sets of each part tell
    # most parts of a class; comparing them all at once would take a large part's size times the parts.
    done = pairs.unionByName(across)
    held = _holding(lists, *marks)
    for label, few in (("few", FEW), ("apart", None)):
        apart = _crossing(scratch, held, labels, percent, label, few)
        apart = scratch.store(apart.join(done, ["u", "v"], "left_anti"), f"{label}-pairs")
        if apart.isEmpty():
            continue
        done = done.unionByName(apart)
        possible = scratch.store(_possible(scratch, apart, sketches, percent, label), label)
        more = _verified(scratch, possible, members, percent, label)
        if not more.isEmpty():
            labels = _merged(scratch, labels, more, f"{label}-closed")
    scratch.drop("members", "lists", "across-mixed", "few-mixed", "apart-mixed", "candidates")
    classed = (rows.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
               .withColumn("class", F.coalesce("component", "sid")))
    # The smallest id of each class; rows without a set are classes of their own.
    least = classed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = classed.join(least, "class", "left")
    return out.select("doc_id", "tkey", F.col("n").cast("long").alias("n"), "class",
                      F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component")), scratch


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its set's size and its class's smallest id."""
    return classes(docs, id_col, text_col, width, percent)[0].select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
