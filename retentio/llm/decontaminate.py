"""Benchmark decontamination with a generalised suffix automaton over words (operator 5).

All benchmark items, as word ids, go into one suffix automaton. A document's words are
streamed through it; at each word the automaton knows the longest run ending there that
occurs in some item. A run of at least ``window`` words marks those words as hit, and the
items are read off the state of the run's last ``window`` words. An item shorter than the
window, but not empty, is one window of its own length.

The automaton holds at most ``block_words`` item words, so what is sent to the tasks is
bounded; a larger benchmark is scanned in several passes, and the passes' findings are
merged row by row. Items are cut with an overlap of ``window - 1`` words where a block ends.

Null texts have no words; a null item id counts as the empty string.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, kept, plain_words, word_spans


class SuffixAutomaton:
    """Suffix automaton of many word sequences, with the items in which each state occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, item, words of the item up to here
        self.names = [name for name, _ in items]
        short: list[tuple[int, int]] = []
        for item, (_, words) in enumerate(items):
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                ends.append((last, item, n))
            if 0 < len(words) < window:
                short.append((item, len(words)))
        self._mark(items, ends, short)

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if symbol in nxt[last]:
            q = nxt[last][symbol]
            return q if length[q] == length[last] + 1 else self._clone(last, symbol, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, symbol, q)
        return new

    def _clone(self, p: int, symbol: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = clone
            p = link[p]
        return clone

    def _mark(self, items, ends, short) -> None:
        """Items of the states that stand for a window, and the short items that end in a state."""
        link, length, window = self.link, self.length, self.window
        self.items: dict[int, set[int]] = {}
        for state, item, n in ends:
            if n >= window:
                while length[link[state]] >= window:
                    state = link[state]
                self.items.setdefault(state, set()).add(item)
        whole: dict[int, list[tuple[int, int]]] = {}  # state -> short items that are its string of that length
        for item, size in short:
            state = 0
            for word in items[item][1]:
                state = self.next[state][self.ids[word]]
            whole.setdefault(state, []).append((item, size))
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        if whole:
            for state in sorted(range(len(length)), key=length.__getitem__):
                own = tuple(whole.get(state, ())) + (self.short.get(link[state], ()) if link[state] >= 0 else ())
                if own:
                    self.short[state] = own

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Hit spans of word positions (merged, rising), items found, longest match."""
        spans: list[list[int]] = []
        found: set[int] = set()
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        ids = self.ids.get
        state, run, longest = 0, 0, 0

        def mark(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                old = spans.pop()
                start, end = min(start, old[0]), max(end, old[1])
            spans.append([start, end])

        for place, word in enumerate(words):
            symbol = ids(word)
            if symbol is None:
                state = run = 0
                continue
            while state and symbol not in nxt[state]:
                state = link[state]
                run = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                run += 1
            longest = max(longest, run)
            if run >= window:
                mark(place + 1 - window, place + 1)
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
            if state in short:
                for item, size in short[state]:
                    if size <= run:
                        mark(place + 1 - size, place + 1)
                        found.add(item)
        return spans, found, longest


def blocks_of(items, window: int, block_words: int) -> list[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words; long items are cut, overlapping."""
    blocks: list[list[tuple[str, list[bytes]]]] = [[]]
    room = block_words
    for name, text in items:
        words = plain_words(text)
        for start in range(0, max(len(words) - window + 1, 1), block_words - window + 1):
            piece = words[start:start + block_words]
            if len(piece) > room:
                blocks.append([])
                room = block_words
            if piece:
                blocks[-1].append((name, piece))
                room -= len(piece)
    return [b for b in blocks if b]


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Blocks one after another; the driver holds one block and the rows of one partition."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            F.col(text_col).alias("text"))
    held: list[tuple[str, str | None]] = []
    size = 0
    for row in rows.toLocalIterator():
        held.append((row["item"], row["text"]))
        size += len(row["text"] or "")
        if size >= 4 * block_words:
            yield from blocks_of(held, window, block_words)
            held, size = [], 0
    yield from blocks_of(held, window, block_words)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = 10, block_words: int = 200_000, finish=None) -> DataFrame:
    """``docs`` with a column ``_leak``: word count, hit spans (flat start, end pairs), items, longest match.

    ``finish``, if given, turns each batch of the last pass into rows of ``docs``' columns; it runs in the
    worker that scans, so that a task never needs a second one.
    """
    spark = docs.sparkSession
    kind = "struct<n_words: bigint, n_hit: bigint, spans: array<int>, items: array<string>, longest: int>"
    empty = "named_struct('n_words', 0L, 'n_hit', 0L, 'spans', array(), 'items', array(), 'longest', 0)"
    out = docs.withColumn("_leak", F.expr(f"cast({empty} as {kind})"))
    scratch, step = Scratch(spark, "leaks"), 0
    blocks = _item_blocks(benchmark, item_col, item_text_col, window, block_words)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast((block, window))
        scan = _scanner(sent, f"{scratch.root}/{step}", text_col)
        if following is None:
            return out.mapInArrow(_finished(scan, finish), docs.schema) if finish else out.mapInArrow(scan, out.schema)
        out = out.mapInArrow(scan, out.schema)
        out = scratch.store(out, f"pass{step}")
        if step:
            scratch.drop(f"pass{step - 1}")
        block, step = following, step + 1


def _scanner(sent, name: str, text_col: str):
    """Scans for the block of items ``sent``, whose ``name`` no other block has."""
    def scanned(batches):
        mine = kept("decontaminate")
        if mine.get("block") != name:  # built once for a worker, not for each task
            mine.clear()
            mine.update(block=name, automaton=SuffixAutomaton(*sent.value))
        automaton = mine["automaton"]
        for batch in batches:
            at = batch.schema.get_field_index("_leak")
            rows = []
            for text, old in zip(batch.column(text_col).to_pylist(), batch.column("_leak").to_pylist()):
                words = plain_words(text)
                spans, found, longest = automaton.scan(words)
                flat = merge_spans([*spans, *zip(old["spans"][::2], old["spans"][1::2])])
                rows.append({"n_words": len(words), "n_hit": sum(e - s for s, e in flat),
                             "spans": [x for s in flat for x in s],
                             "items": sorted({automaton.names[i] for i in found} | set(old["items"])),
                             "longest": max(longest, old["longest"])})
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return scanned


def _finished(scan, finish):
    def both(batches):
        for batch in scan(batches):
            yield finish(batch)

    return both


def merge_spans(spans) -> list[list[int]]:
    """Union of spans, rising; those that touch become one."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """The text with each span, and what stands between its words, replaced by a line break."""
    places = word_spans(text)
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return "\n".join(out)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = 10, max_coverage: float = 0.5, length_col: str | None = None,
          block_words: int = 200_000) -> DataFrame:
    """``docs`` without leaked spans, and without documents more than ``max_coverage`` of whose words leaked.

    Spans are runs of at least ``window`` item words (or a whole shorter item); their words go,
    and the gap becomes a line break. ``length_col``, if given, is set to the
    new text's code points in the rows that change. Untouched rows stay as they are.
    """
    text_at, cols = docs.columns.index(text_col), docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaks = batch.column("_leak").to_pylist()
        stays = [s["n_hit"] <= s["n_words"] * max_coverage for s in leaks]
        if not all(stays):
            batch, leaks = batch.filter(pa.array(stays, pa.bool_())), [s for s, stay in zip(leaks, stays) if stay]
        if any(s["spans"] for s in leaks):
            texts = batch.column(text_at).to_pylist()
            lengths = batch.column(length_col).to_pylist() if length_col else None
            for i, s in enumerate(leaks):
                if s["spans"]:
                    texts[i] = remove_spans(texts[i], list(zip(s["spans"][::2], s["spans"][1::2])))
                    if lengths:
                        lengths[i] = len(texts[i])
            batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
            if lengths:
                at = batch.schema.get_field_index(length_col)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(lengths, batch.schema.field(at).type))
        return batch.select(cols)

    return find(docs, benchmark, text_col, item_col, item_text_col, window, block_words, finish=cut)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           window: int = 10) -> DataFrame:
    """One row per document: words, hit words, items, their digest and the longest match."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find(slim, benchmark, "text", window=window)
    return found.select(
        "doc_id", F.col("_leak.n_words").alias("n_words"), F.col("_leak.n_hit").alias("n_hit"),
        F.size("_leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_leak.items"), ","), 256).alias("items_sha256"),
        (F.col("_leak.n_hit") > 0).alias("contaminated"))
