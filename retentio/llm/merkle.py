"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

H is the lowercase hex SHA-256 of its inputs end to end; digests go in as hex text. A row's leaf
is H of its fields, each ``-`` if null, else the UTF-8 byte count, ``:`` and the value. Leaves of
a group (null is a group) ascend by id; while several nodes remain, every three consecutive ones
(the last run: fewer, even one) become their H. What remains is the group's subroot; the
subroots, ordered by group (null first, bytewise), give the root in the same way.

``build`` makes the trees bottom-up, three levels a step. For every node it keeps the segment
towards its parent: the siblings left and right of it. ``proofs`` then jumps pointers: a node
knows an ancestor and the segments up to it; a self-join brings the ancestor's own segments and
pointer, so that distances double until every leaf points at the root. Many nodes share an
ancestor: these joins deal heavy keys in parts (``hot_join``), and of the inner nodes only those
that a leaf will still land on go on.

Null ids come first in their group; rows that agree in group and id are ordered by leaf digest,
equal rows by place in the input, and each has its own leaf. A null text is not an empty one. A
text is hashed in its row; only digests travel, so its length does not matter. Only the named columns are read. An
empty table has no root and no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import Scratch
from retentio.operators.hot_join import join_hot
from retentio.operators.rank import exact_rank

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels built at a step, and the leaves of such a block.
STEP, BLOCK = 3, 27
#: Number of the tree over the subroots.
TOP = -1


@dataclass
class Manifest:
    """``leaves``: id, leaf, claimed (null: as leaf), tree, idx, height; ``segments``: of every node that has a parent."""
    scratch: Scratch
    leaves: DataFrame
    segments: DataFrame
    subroots: DataFrame
    root: str | None
    top_height: int


def encode(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """SHA-256 of the encoded values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encode, values)).cast("binary"), 256))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _join(parts: Column) -> Column:
    """Byte strings of an array end to end."""
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def _height(n: Column) -> Column:
    """Levels over n leaves: the least k with 3^k >= n."""
    return sum(((n > F.lit(3 ** k)).cast("int") for k in range(39)), F.lit(0))


def _parents(name: str) -> Column:
    """H of every run of three in an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(name) - 1) / 3).cast("int"))
    return F.transform(runs, lambda i: F.unhex(F.sha2(_hex(_join(F.slice(name, i * 3 + 1, F.lit(3)))), 256)))


def _siblings(name: str, level: int) -> Column:
    """For every digest of an array: its place and the siblings on both sides."""
    def one(p: Column) -> Column:
        start = p - p % 3
        return F.struct(F.lit(level).alias("level"), p.cast("long").alias("place"),
                        _join(F.slice(name, start + 1, p - start)).alias("left"),
                        _join(F.slice(name, p + 2, start + 2 - p)).alias("right"))
    return F.transform(F.sequence(F.lit(0), F.size(name) - 1), one)


def _grow(scratch: Scratch, nodes: DataFrame, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Trees over ``nodes`` (tree, idx, h, height): segments (tree, level, idx, left, right, height) and tops (tree, h)."""
    # Trees of one leaf have no segment.
    none = nodes.sparkSession.createDataFrame([], "tree long, level int, idx long, left binary, right binary, height int")
    segments, tops = [none], [nodes.filter("height = 0").select("tree", "h")]
    highest = nodes.agg(F.max("height")).first()[0] or 0
    current = nodes.filter("height > 0")
    for level in range(0, highest, STEP):
        grouped = current.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block"), "height").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("a0"))
        for k in range(STEP):
            grouped = grouped.withColumn(f"a{k + 1}", F.when(F.col("height") > level + k, _parents(f"a{k}")))
        blocks = scratch.store(grouped, f"{label}-{level}")
        for k in range(STEP):
            each = blocks.filter(F.col("height") > level + k).select("tree", "height", "block", F.explode(_siblings(f"a{k}", level + k)).alias("s"))
            segments.append(each.select("tree", "s.level", (F.col("block") * (BLOCK // 3 ** k) + F.col("s.place")).alias("idx"),
                                        "s.left", "s.right", "height"))
            tops.append(blocks.filter(F.col("height") == level + k + 1).select("tree", F.element_at(f"a{k + 1}", 1).alias("h")))
        current = blocks.filter(F.col("height") > level + STEP).select(
            "tree", F.col("block").alias("idx"), F.element_at(f"a{STEP}", 1).alias("h"), "height")
    return segments, tops


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(docs: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
          group_col: str = "source", claims: dict[str, Column] | None = None) -> Manifest:
    """Trees over all rows. ``claims`` are field values that someone presents instead; their leaf is kept as ``claimed``."""
    claims = claims or {}
    leaf = digest(*[F.col(c) for c in fields])
    claimed = digest(*[claims.get(c, F.col(c)) for c in fields]) if claims else leaf
    slim = scratch.store(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("leaf"),
                                     claimed.alias("claimed"), F.monotonically_increasing_id().alias("row"))
                         .withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed"))), "slim")
    # Place among all rows; a group's rows are neighbours, so its first place and its size number them.
    placed = scratch.store(exact_rank(slim, ["group", "id", "leaf", "row"], total_col=None), "placed")
    groups = scratch.store(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first")), "groups")
    trees = scratch.store(exact_rank(groups, ["first"], "tree", None).select(
        "group", (F.col("tree") - 1).alias("tree"), "first", _height(F.col("n")).alias("height")), "trees")
    leaves = scratch.store(join_hot(placed, trees, ["group"], F.col("rn")).select(
        "id", "leaf", "claimed", "tree", (F.col("rn") - F.col("first")).alias("idx"), "height"), "leaves")
    scratch.drop("slim", "placed")
    segments, tops = _grow(scratch, leaves.select("tree", "idx", F.col("leaf").alias("h"), "height"), "group")
    subroots = scratch.store(_all(tops), "subroots")
    n = trees.count()
    top_height = math.ceil(round(math.log(n, 3), 9)) if n else 0
    top_segments, top = _grow(scratch, subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "h",
                                                       F.lit(top_height).alias("height")), "top")
    root = _all(top).select(_hex(F.col("h"))).first()
    kept = scratch.store(_all(segments + top_segments), "segments")
    return Manifest(scratch, leaves, kept, subroots, root[0] if root else None, top_height)


def _pointers(manifest: Manifest) -> DataFrame:
    """Every node with a parent: (tree, level, idx), one segment, and where the parent is (null: the root)."""
    single = F.array(F.struct("left", "right"))
    nodes = manifest.segments.select("tree", "level", "idx", single.alias("path"), "height")
    # A leaf that is its group's subroot points at that without a segment.
    alone = manifest.leaves.filter("height = 0").select(
        "tree", F.lit(0).alias("level"), "idx", F.slice(F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))), 1, 0)
        .alias("path"), "height")
    is_top = F.col("tree") == TOP
    leaves_tree = ~is_top & (F.col("level") + 1 >= F.col("height"))
    ends = (is_top & (F.col("level") + 1 == F.col("height"))) | (leaves_tree & F.lit(manifest.top_height == 0))
    up = F.when(ends, None)
    return nodes.unionByName(alone).select(
        "tree", "level", "idx", "path",
        up.otherwise(F.when(leaves_tree, F.lit(TOP).cast("long")).otherwise(F.col("tree"))).alias("up_tree"),
        up.otherwise(F.when(leaves_tree, F.lit(0)).otherwise(F.col("level") + 1)).alias("up_level"),
        up.otherwise(F.when(leaves_tree, F.col("tree")).otherwise(F.floor(F.col("idx") / 3))).alias("up_idx"))


KEY, UP = ["tree", "level", "idx"], ["up_tree", "up_level", "up_idx"]


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, idx, path) of every leaf: its siblings (left, right) at each level from leaf to root."""
    scratch = manifest.scratch
    highest = (manifest.leaves.agg(F.max("height")).first()[0] or 0) + manifest.top_height
    is_leaf = (F.col("tree") != TOP) & (F.col("level") == 0)
    nodes = scratch.store(_pointers(manifest), "jump-0")
    done = [nodes.filter(is_leaf & F.col("up_tree").isNull())]
    far, turn = 1, 0
    while far < max(highest, 2):
        # Every open node points at the one ``far`` levels above it; leaves will land on multiples of twice that.
        far, turn = 2 * far, turn + 1
        rooted = F.col("up_tree").isNull()
        needed = is_leaf | (F.col("tree") == TOP) | (F.col("level") % far == 0)
        open_nodes = scratch.store(nodes.filter(~rooted & needed), f"open-{turn}")
        above = nodes.filter(~is_leaf).select(*[F.col(k).alias(u) for k, u in zip(KEY, UP)], F.col("path").alias("_path"),
                                              *[F.col(u).alias(f"_{u}") for u in UP])
        jumped = join_hot(open_nodes, above, UP, F.struct("tree", "idx"), "inner").select(
            *KEY, F.concat("path", "_path").alias("path"), *[F.col(f"_{u}").alias(u) for u in UP])
        last, nodes = nodes, scratch.store(jumped.unionByName(nodes.filter(rooted & ~is_leaf & needed)), f"jump-{turn}")
        done.append(nodes.filter(is_leaf & rooted))
        scratch.drop(f"open-{turn}")
    return _all(done).select("tree", "idx", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The hash that a leaf and the siblings of a path lead to, as hex text."""
    return F.aggregate(path, _hex(leaf), lambda acc, s: F.sha2(F.concat(_hex(s["left"]), acc, _hex(s["right"])), 256))


def verify(manifest: Manifest) -> DataFrame:
    """Every row's leaf, subroot, proof digest, and whether its claimed fields fold to the root."""
    found = manifest.leaves.join(proofs(manifest), ["tree", "idx"])
    siblings = F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))
    folded = fold(F.coalesce("claimed", "leaf"), F.col("path"))
    return found.select(
        "id", _hex(F.col("leaf")).alias("leaf"), fold(F.col("leaf"), F.slice("path", F.lit(1), F.col("height"))).alias("subroot"),
        F.lit(manifest.root).alias("root"), F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
