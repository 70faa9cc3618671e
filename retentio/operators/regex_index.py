"""Regex search of ids through trigram postings.

A pattern's required literal runs are read from its text: parts that every match must hold. Their
trigrams are looked up in postings (trigram, id) made of the ids; each pattern follows the trigram
with the fewest ids, and the ids found there are checked for its other trigrams and then against the regex itself.
So an id never meets a pattern with which it shares no trigram. Patterns without a literal run of
three characters cannot be looked up; ``lookup_customer`` tests those on every id.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from retentio.operators.hot_join import join_hot
from retentio.session import ship_code

#: Patterns that share a trigram are tested together in blocks of about so many.
PATTERN_BLOCK = 256
_QUANTIFIER = re.compile(r"(?:([*?+])|\{(\d+)(?:,\d*)?\})[?+]?")


class _Unsure(Exception):
    """The pattern uses something that this reader does not follow."""


def required_runs(pattern: str) -> list[str]:
    """Lower-case ASCII texts that every case-insensitive match holds; none where that is not sure."""
    try:
        runs, end, _ = _alternatives(pattern, 0)
    except _Unsure:
        return []
    return [r for r in runs if r] if end == len(pattern) else []


def _alternatives(p: str, i: int) -> tuple[list[str], int, bool]:
    """Runs of a sequence up to its closing bracket; a choice between sequences requires none."""
    runs, run, chosen = [], "", False
    while i < len(p) and p[i] != ")":
        c, literal, inner = p[i], "", []
        if c == "|":
            chosen, i = True, i + 1
            runs, run = [*runs, run], ""
            continue
        if c == "\\":
            if i + 1 >= len(p) or p[i + 1] in "pPxukcNQE" or p[i + 1].isdigit():
                raise _Unsure
            literal, i = ("" if p[i + 1].isalpha() else p[i + 1]), i + 2
        elif c == "[":
            i = _class_end(p, i)
        elif c == "(":
            flags = re.match(r"\(\?i\)", p[i:])
            if flags:
                i += flags.end()
                continue
            if p.startswith("(?:", i):
                i += 3
            elif p.startswith("(?", i):
                raise _Unsure
            else:
                i += 1
            inner, i, choice = _alternatives(p, i)
            if i >= len(p):
                raise _Unsure
            inner, i = ([] if choice else inner), i + 1
        elif c in "*+?{}]":
            raise _Unsure
        else:
            literal, i = ("" if c in ".^$" else c), i + 1
        times = _QUANTIFIER.match(p, i)
        least = 1 if not times else int(times[2]) if times[2] else int(times[1] == "+")
        i = times.end() if times else i
        if literal and literal.isascii() and least:
            run += literal.lower()
        if times or not literal or not literal.isascii():
            # Whatever follows need not be next to what stands before.
            runs, run = [*runs, run, *(inner if least else [])], ""
    return ([] if chosen else [*runs, run]), i, chosen


def _class_end(p: str, i: int) -> int:
    depth, start = 0, i
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            depth += 1
        elif p[i] == "]":
            if i == start + 1 or p[start:i] == "[^":
                raise _Unsure
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise _Unsure


def trigrams(pattern: str) -> list[str]:
    """Trigrams of all required runs, without repeats."""
    return sorted({run[k:k + 3] for run in required_runs(pattern) for k in range(len(run) - 2)})


def with_trigrams(patterns: DataFrame, col: str = "query") -> DataFrame:
    """``patterns`` with their required trigrams as ``_tris`` (a table of search strings, not of rows searched)."""
    ship_code(patterns.sparkSession)
    required = F.udf(lambda p: trigrams(p or ""), "array<string>")
    return patterns.withColumn("_tris", required(F.trim(col)))


def candidates(ids: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_id, query, _pat): ids that hold all trigrams of a pattern, found by its rarest one.

    ``ids`` has _id and its lower-case form _lid; ``patterns`` has query, _pat and _tris (not empty).
    """
    wanted = patterns.select("query", F.explode("_tris").alias("_tri"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("_lid") - 2), lambda i: F.substring(F.col("_lid"), i, F.lit(3)))
    postings = (ids.filter(F.length("_lid") >= 3).select("_id", "_lid", F.explode(F.array_distinct(pieces)).alias("_tri"))
                .join(wanted.select("_tri").distinct(), "_tri", "left_semi")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = postings.groupBy("_tri").agg(F.count(F.lit(1)).alias("_df"))
    # A trigram without postings means that nothing can match: such patterns drop out of the inner join below.
    rarest = (wanted.join(counts, "_tri", "left").groupBy("query")
              .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_tri")).alias("_pick")))
    picked = patterns.join(rarest, "query").select("query", "_pat", "_tris", F.col("_pick._tri").alias("_tri"))
    blocks = picked.groupBy("_tri").agg(F.ceil(F.count(F.lit(1)) / F.lit(PATTERN_BLOCK)).alias("_blocks"))
    lists = (picked.join(blocks, "_tri").withColumn("_block", F.pmod(F.xxhash64("query"), "_blocks"))
             .groupBy("_tri", "_block").agg(F.collect_list(F.struct("query", "_pat", "_tris")).alias("_pats")))
    # Common trigrams are heavy keys on the side of the postings: both joins deal them in parts.
    dealt = join_hot(postings, blocks, ["_tri"], F.col("_id"), "inner").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks").persist(StorageLevel.MEMORY_AND_DISK)
    met = join_hot(dealt, lists, ["_tri", "_block"], F.col("_id"), "inner")
    holds = F.filter("_pats", lambda p: F.forall(p["_tris"], lambda t: F.contains(F.col("_lid"), t)))
    return met.select("_id", F.explode(holds).alias("_m")).select("_id", "_m.query", "_m._pat")


def search(ids: DataFrame, patterns: DataFrame, id_col: str) -> DataFrame:
    """(query, smallest id that matches) of patterns with trigrams."""
    found = candidates(ids, patterns).filter(F.regexp_like(F.col("_id"), F.col("_pat")))
    return found.groupBy("query").agg(F.min("_id").alias(id_col))
