"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt as the head of its base conversation followed by its own suffix. No
rebuilt text is ever made. Turns are elements of a monoid: a run of turns has the fingerprint
(count, code points, sum of x_i * B^i mod p in four lanes), and two runs combine as
(n + m, c + d, f + B^n * g). So

* the running products of every stored conversation are taken once, in the order of turns,
  by segments: each task multiplies its own rows, and the product of what a conversation has in
  earlier tasks is combined in front (one or two rows for each task go through the driver);
* a rebuilt prefix is the base's product up to the head combined with the quotient of two of
  the conversation's own products, an expression over five numbers;
* equal fingerprints of equal depth make a node. Its members are verified: each refers to its
  last stored turn and its parent prefix, and the turns' SHA-256 and the parents must agree. By
  induction over the depth the sequences are then equal. If any group fails, all fingerprints
  are taken anew with other bases, so a result never rests on a false match.

Sums over subtrees need no walk. The smallest member of a node owns it; what a conversation owns
is a run of its prefixes from some depth to its end. So a node's leaves, children and saved
tokens are sums over its members of numbers that each member knows. A prefix shared by very many
conversations is combined in the tasks before the shuffle; joins deal heavy keys in parts.

Turns are ordered by ``turn`` (null first), rows that agree in it by the digest of role and text;
equal rows count as often as they occur. Null role or text is empty. Rows with a null conv_id are
one conversation without a base, the largest of all; as a member's id it is the empty string. Ids are integers.
Texts of any length are hashed in their row, and only digests travel. Only conv_id, turn, role and
text are read. An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, arrow_batches
from retentio.operators.hot_join import join_hot

#: Modulus and number of lanes of a fingerprint; two lanes are packed into a long.
PRIME = (1 << 31) - 1
LANES = 4
#: Base turns that a head can have at most.
MOST_HEAD = 5
#: Ids whose text is one piece of a member list.
PIECE = 4096
SEEDS = 8
NODE = ["depth", "f1", "f2"]


def bases_of(seed: int) -> list[int]:
    chance = random.Random(seed)
    return [chance.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]


def powers(base: int, exponents: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """base ** exponents mod prime, elementwise."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(prime), out)
        square = square * square % np.uint64(prime)
        left = left >> np.uint64(1)
    return out


def running_products(bases: list[int], prime: int):
    """For mapInArrow over rows sorted by conversation: place in the task's run, products before and after the turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, points, lanes = TaskContext.get().partitionId(), None, 0, 0, [0] * LANES
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv")
            codes = pc.fill_null(pc.dictionary_encode(conv).indices, -1).to_numpy(zero_copy_only=False)
            begins = np.concatenate([[True], codes[1:] != codes[:-1]])
            start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            first = start == 0
            goes_on = last is not None and last == (conv[0].as_py(),)
            before = np.where(first, seen if goes_on else 0, 0)
            place = np.arange(n) - start + before
            chars = batch.column("chars").to_numpy()
            total = np.concatenate([[0], np.cumsum(chars)])
            upto = total[1:] - total[start] + np.where(first & goes_on, points, 0)
            words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").astype(np.uint64).reshape(n, LANES)
            columns = [conv, pa.array([part] * n, pa.int32()), pa.array(place + 1, pa.int64()), pa.array(chars, pa.int64()),
                       pa.array(upto, pa.int64()), *[pa.array(words[:, k].view(np.int64)) for k in range(LANES)]]
            after_lanes, before_lanes = [], []
            for k in range(LANES):
                x = words[:, k] % np.uint64(prime - 1) + np.uint64(1)
                term = x * powers(bases[k], place, prime) % np.uint64(prime)
                sums = np.concatenate([[0], np.cumsum(term, dtype=np.uint64)]).astype(np.uint64)
                carried = np.where(first & goes_on, np.uint64(lanes[k]), np.uint64(0)).astype(np.uint64)
                after = (sums[1:] - sums[start] + carried) % np.uint64(prime)
                after_lanes.append(after)
                before_lanes.append((after + np.uint64(prime) - term) % np.uint64(prime))
            columns += [pa.array(v.astype(np.int64)) for v in after_lanes + before_lanes]
            last, seen, points = (conv[n - 1].as_py(),), int(place[-1]) + 1, int(upto[-1])
            lanes = [int(v[-1]) for v in after_lanes]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)
    return run


AFTER, BEFORE, WORDS = [[f"{p}{k}" for k in range(LANES)] for p in ("g", "q", "x")]
NAMES = ["conv", "part", "pos", "chars", "upto", *WORDS, *AFTER, *BEFORE]


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = conversations.select(F.col("conv_id").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"),
                                F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "digest", "row"]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars")


def _placed(conversations: DataFrame, scratch: Scratch, bases: list[int], prime: int, label: str) -> DataFrame:
    """Every turn with its place in its conversation and the products before and after it."""
    spark = conversations.sparkSession
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv {kind}, part int, " + ", ".join(f"{c} long" for c in NAMES[2:])
    with arrow_batches(spark, 10_000):
        turns = scratch.store(_sorted_turns(conversations).mapInArrow(running_products(bases, prime), schema), f"turns-{label}")
    # A conversation that several tasks hold: at most the first and the last one of each task.
    runs = turns.groupBy("conv", "part").agg(F.max("pos").alias("n"), F.max("upto").alias("upto"), F.max(F.struct("pos", *AFTER)).alias("end"))
    split = runs.withColumn("runs", F.count("*").over(Window.partitionBy("conv"))).filter("runs > 1").collect()
    if not split:
        return turns
    carried, state = [], {}
    for r in sorted(split, key=lambda r: r["part"]):
        n, points, lanes = state.get(r["conv"], (0, 0, [0] * LANES))
        factors = [pow(b, n, prime) for b in bases]
        carried.append((r["conv"], r["part"], n, points, *lanes, *factors))
        joined = [(g + f * r["end"][c]) % prime for g, f, c in zip(lanes, factors, AFTER)]
        state[r["conv"]] = n + r["n"], points + r["upto"], joined
    lanes, factors = [[f"_{p}{k}" for k in range(LANES)] for p in ("l", "f")]
    listed = spark.createDataFrame(carried, f"_conv {kind}, _part int, _n long, _upto long, "
                                   + ", ".join(f"{c} long" for c in lanes + factors))
    joined = turns.join(F.broadcast(listed), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    none = lambda c, v=0: F.coalesce(F.col(c), F.lit(v).cast("long"))
    combine = lambda c, k: ((none(lanes[k]) + none(factors[k], 1) * F.col(c)) % prime).alias(c)
    whole = joined.select("conv", "part", (F.col("pos") + none("_n")).alias("pos"), "chars", (F.col("upto") + none("_upto")).alias("upto"),
                          *WORDS, *[combine(AFTER[k], k) for k in range(LANES)], *[combine(BEFORE[k], k) for k in range(LANES)])
    stored = scratch.store(whole, f"placed-{label}")
    scratch.drop(f"turns-{label}")
    return stored


def _plans(turns: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], bases: list[int],
           prime: int) -> DataFrame:
    """One row for each conversation: its head (the base's first turns), and how its own suffix joins it."""
    early = F.when(F.col("pos") <= MOST_HEAD, F.struct("pos", "chars", "upto", *WORDS, *AFTER, *BEFORE))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"), F.max("upto").alias("own_total"),
                                      F.array_sort(F.collect_list(early)).alias("early"))
    asked = convs.withColumn("h", head_of(F.col("conv")).cast("int")).withColumn("base", base_of(F.col("conv")))
    known = convs.select(F.col("conv").alias("base"), F.col("early").alias("base_early"))
    joined = asked.join(known, "base", "left").withColumn(
        "heads", F.slice(F.coalesce("base_early", F.slice("early", 1, 0)), F.lit(1), F.col("h"))).withColumn("k", F.size("heads"))
    at = lambda array, i, name: F.when(F.col(i) > 0, F.try_element_at(array, F.col(i))[name]).otherwise(F.lit(0).cast("long"))
    # B^(k - h): own turns move h - k places towards the front if the base is shorter than the head.
    shifts = [F.array(*[F.lit(pow(b, -d, prime)).cast("long") for d in range(MOST_HEAD + 1)]) for b in bases]
    suffix = F.col("n") > F.col("h")
    own_at = lambda name: F.when(suffix, at("early", "h", name)).otherwise(F.lit(0).cast("long"))
    return joined.select(
        "conv", "h", "k", "heads", (F.col("k") + F.when(suffix, F.col("n") - F.col("h")).otherwise(0)).cast("long").alias("len"),
        own_at("upto").alias("own_upto"), at("heads", "k", "upto").alias("head_upto"),
        (at("heads", "k", "upto") + F.when(suffix, F.col("own_total") - own_at("upto")).otherwise(0)).alias("total"),
        *[own_at(AFTER[i]).alias(f"own{i}") for i in range(LANES)], *[at("heads", "k", AFTER[i]).alias(f"head{i}") for i in range(LANES)],
        *[F.element_at(shifts[i], F.col("h") - F.col("k") + 1).alias(f"shift{i}") for i in range(LANES)])


def _packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    return [(F.shiftleft(lanes[2 * i], 31) + lanes[2 * i + 1]).alias(name) for i, name in enumerate(names)]


def _prefixes(turns: DataFrame, plans: DataFrame, prime: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: node key, parent's key, code points before its last turn, the turn's digest."""
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    ends = ["conv", "len", "total"]
    roots = plans.select(*ends, zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), none.alias("p1"), none.alias("p2"),
                         zero.alias("before"), zero.alias("chars"), *[zero.alias(x) for x in WORDS])
    head = plans.select(*ends, F.explode("heads").alias("t"))
    of = lambda names: [F.col(f"t.{c}") for c in names]
    heads = head.select(*ends, F.col("t.pos").alias("depth"), *_packed(of(AFTER), ("f1", "f2")), *_packed(of(BEFORE), ("p1", "p2")),
                        (F.col("t.upto") - F.col("t.chars")).alias("before"), F.col("t.chars").alias("chars"),
                        *[F.col(f"t.{x}").alias(x) for x in WORDS])
    own = join_hot(turns.select("conv", "pos", "chars", "upto", *WORDS, *AFTER, *BEFORE), plans.drop("heads"), ["conv"], F.col("pos"),
                   "inner").filter(F.col("pos") > F.col("h"))
    moved = lambda names: [(F.col(f"head{i}") + (F.col(c) + prime - F.col(f"own{i}")) % prime * F.col(f"shift{i}")) % prime
                           for i, c in enumerate(names)]
    owns = own.select(*ends, (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), *_packed(moved(AFTER), ("f1", "f2")),
                      *_packed(moved(BEFORE), ("p1", "p2")),
                      (F.col("head_upto") + F.col("upto") - F.col("chars") - F.col("own_upto")).alias("before"), "chars", *WORDS)
    return roots.unionByName(heads).unionByName(owns)


def _groups(prefixes: DataFrame) -> DataFrame:
    """Prefixes of one fingerprint, and whether all members' last turns and parents agree."""
    checked = ["p1", "p2", "before", "chars", *WORDS]
    agree = F.lit(True)
    for c in checked:
        agree = agree & F.min(c).eqNullSafe(F.max(c))
    return prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.max("before").alias("before"),
        (F.sum((F.col("len") == F.col("depth")).cast("long")) == F.count("*")).alias("childless"), agree.alias("agree"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of each node in the task's sorted rows, in pieces of bounded length."""
    part, number, key, ids = TaskContext.get().partitionId(), 0, None, []

    def piece():
        return pa.RecordBatch.from_pylist([dict(zip(NODE, key), part=part, number=number, ids=",".join(ids))], schema=PIECES)
    for batch in batches:
        out = []
        for *this, text in zip(*[batch.column(c).to_pylist() for c in (*NODE, "text")]):
            if key is not None and (this != key or len(ids) == PIECE):
                out.append(piece())
                number, ids = number + 1, []
            key = this
            ids.append(text)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if key is not None:
        yield piece()


PIECES = pa.schema([*[(c, pa.int64()) for c in NODE], ("part", pa.int32()), ("number", pa.int64()), ("ids", pa.string())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which arrive one after the other; only the state is held."""
    kinds = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])
    key, state = None, None
    row = lambda: dict(zip(NODE, key), ends_sha256=state.hexdigest())
    for batch in batches:
        out = []
        for *this, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
            if this == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append(row())
            key, state = this, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=kinds)


def _ends(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """The digest of the ids that end at a node. Tasks join sorted ids to pieces; one node's pieces are hashed in a row."""
    order = [*NODE, F.col("conv").asc_nulls_last()]
    ids = prefixes.filter("depth = len").select(*NODE, "conv", F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("text"))
    pieces = ids.repartitionByRange(*order).sortWithinPartitions(*order).select(*NODE, "text").mapInArrow(
        _pieces, "depth long, f1 long, f2 long, part int, number long, ids string")
    with arrow_batches(prefixes.sparkSession, 1_000):
        stored = scratch.store(pieces, "pieces")
        hashed = stored.repartition(*NODE).sortWithinPartitions(*NODE, "part", "number").mapInArrow(
            _hashes, "depth long, f1 long, f2 long, ends_sha256 string")
        return scratch.store(hashed, "ends")


def trie(conversations: DataFrame, scratch: Scratch, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column],
         prime: int = PRIME, seeds: int = SEEDS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base_of`` and ``head_of`` give the base conversation of an id and the length of its head (0
    to 5). A smaller ``prime`` makes false matches likely, for tests.
    """
    for seed in range(seeds):
        bases = [b % prime or 1 for b in bases_of(seed)]
        turns = _placed(conversations, scratch, bases, prime, str(seed))
        plans = scratch.store(_plans(turns, base_of, head_of, bases, prime), f"plans-{seed}")
        prefixes = scratch.store(_prefixes(turns, plans, prime), f"prefixes-{seed}")
        groups = scratch.store(_groups(prefixes), f"groups-{seed}")
        if groups.filter("not agree").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"unlike prefixes share a fingerprint under each of {seeds} sets of bases")
    # A conversation owns its prefixes from some depth on: where that begins, and whether its last node is a leaf.
    owners = groups.groupBy("conv").agg(F.min(F.struct("depth", "before")).alias("first"), F.max("childless").alias("leaf")).select(
        "conv", F.col("first.depth").alias("top"), F.col("first.before").alias("stop"), "leaf")
    rows = join_hot(prefixes, owners, ["conv"], F.col("depth")).withColumns({
        "top": F.coalesce("top", F.col("len") + 1), "stop": F.coalesce("stop", "total"), "leaf": F.coalesce("leaf", F.lit(False))})
    below = F.col("depth") + 1
    nodes = scratch.store(rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("top").alias("top"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"), F.sum(((F.col("top") <= below) & (below <= F.col("len"))).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("top"), F.col("stop") - F.col("before")).otherwise(0)).alias("saved_tokens")), "nodes")
    # Below its top a chain's parent has the same owner; only tops look theirs up.
    hangs = (F.col("depth") == F.col("top")) & (F.col("depth") > 0)
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
                        F.col("conv_id").alias("parent_conv_id"))
    tops = join_hot(nodes.filter(hangs), over, ["depth", "p1", "p2"], F.col("f1"), "inner")
    rest = nodes.filter(~hangs).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return rest.unionByName(tops).join(_ends(prefixes, scratch), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
