"""Best-fit packing of token sequences by a grouping genetic algorithm on islands (operator 4).

Documents are tokenised, closed by an end id, and cut only where they exceed a sequence;
full pieces take a sequence of their own. All other pieces are dealt by hash into blocks of
about ``block_items``; each block is packed by several islands, one Spark group for each
(block, island). An individual is a list of bins. Crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold a duplicate, and best-fits the
displaced pieces in falling size; mutation empties a few poorly filled bins. Fitness is the
mean square of the bins' fill. Between epochs each island's best individual migrates to the
next island of its block, by a join on the pieces. After the last epoch the best island
of each block wins; pieces of its poorly filled bins are pooled over all blocks and packed
again, in fewer blocks, until one block is left or a round no longer gains.

Only (piece, length, bin) rows are shuffled. Null texts are empty: one piece, the end id alone.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, kept

#: Bytes of words, and of parts of words, whose ids a worker keeps; beyond, it starts anew.
KEPT_BYTES = 130 << 20, 130 << 20
#: Bytes of text that are encoded together: what a batch of long texts adds stays small.
SLICE_BYTES = 16 << 20
#: What a kept name costs besides its own characters and ids: string, dictionary entry, places.
NAME_BYTES = 190
#: Words of these characters only (no apostrophe, nothing that composes) split into parts that are encoded alone.
SIMPLE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Kept:
    """Id sequences by name, end to end in one array."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.held = 0

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.place), len(names)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used:self.used + len(ids)] = ids
        self.size[n:n + m] = sizes
        self.start[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.held += sum(map(len, names)) + NAME_BYTES * m + 4 * len(ids)
        self.place.update(zip(names, range(n, n + m)))

    def joined(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the places, end to end, and where each begins (n + 1)."""
        size = self.size[places]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.start[places] - ends[:-1], size) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of texts, with the ids of recent words kept.

    The tokenizer drops white space and treats what stands between white space
    independently, so a text's ids are those of its words end to end; in the same way a
    word of plain letters, digits and signs is its runs of each, in lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        closing = sorted(i for name, i in self.tokenizer.get_vocab().items() if name.endswith("</w>"))
        self.closes = np.zeros(max([0, *closing]) + 2, bool)
        self.closes[closing] = True
        self.words, self.parts = Kept(), Kept()

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [code.ids for code in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn_parts(self, names: list[str]) -> None:
        for at in range(0, len(names), 512):
            some = names[at:at + 512]
            ids = np.array(self._encoded([" ".join(some)])[0], np.uint32)
            last = np.flatnonzero(self.closes[np.minimum(ids, len(self.closes) - 1)])
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                self.parts.add(some, ids, np.diff(last, prepend=-1))
            else:
                each = self._encoded(some)
                self.parts.add(some, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each]))

    def _learn(self, names: list[str]) -> None:
        parts: list[str] = []
        simple, counts, other = [], [], []
        for word in names:
            if word.isascii() and word.isalpha():
                parts.append(word.lower())
                counts.append(1)
            elif (word.isascii() and word.isprintable() and "'" not in word or SIMPLE.fullmatch(word)) and "<|" not in word:
                own = PART.findall(word.lower())
                parts += own
                counts.append(len(own))
            else:
                other.append(word)
                continue
            simple.append(word)
        place = self.parts.place
        self._learn_parts([p for p in dict.fromkeys(parts) if p not in place])
        ids, ends = self.parts.joined(np.fromiter(map(place.__getitem__, parts), np.int64, len(parts)))
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.words.add(simple, ids, np.diff(ends[at]))
        each = self._encoded(other) if other else []
        self.words.add(other, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        names = coded.dictionary.to_pylist()
        if not names:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if self.parts.held > KEPT_BYTES[1]:
            self.parts = Kept()
        if self.words.held > KEPT_BYTES[0]:
            self.words = Kept()
        kept = self.words.place
        self._learn([w for w in names if w not in kept])
        place = np.fromiter(map(kept.__getitem__, names), np.int64, len(names))
        ids, ends = self.words.joined(place[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, ends[offsets]

    def encode_slices(self, texts: pa.Array):
        """``encode`` over slices of about SLICE_BYTES: (first row, ids, offsets). A longer text is a slice of its own."""
        sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > SLICE_BYTES:
                yield start, *self.encode(texts.slice(start, i - start))
                start, held = i, 0
            held += size
        if len(texts) > start:
            yield start, *self.encode(texts.slice(start))


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder, which later tasks find again."""
    encoders = kept("packing")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, limit: int, end_id: int) -> DataFrame:
    """One row per piece: its document, place, length and checksum."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for first, ids, offsets in encoder.encode_slices(batch.column("text")):
                docs_at, rows = [], []
                for i in range(len(offsets) - 1):
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(own), limit)):
                        part = own[start:start + limit]
                        docs_at.append(first + i)
                        rows.append((n, start, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(docs_at, pa.int64())),
                     *(pa.array(c, k) for c, k in zip(columns, [pa.int32()] + [pa.int64()] * 3))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


class Rooms:
    """Open bins by the room that is left, with the smallest sufficient room found by bit arithmetic."""

    def __init__(self, capacity: int):
        self.by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.capacity = capacity

    def put(self, members: list[int], room: int) -> None:
        self.by_room[room].append(members)
        self.mask |= 1 << room

    def best(self, size: int) -> tuple[list[int], int]:
        """Take out the fullest bin that has room for ``size``, or a new one."""
        above = self.mask >> size
        if not above:
            return [], self.capacity
        room = size + (above & -above).bit_length() - 1
        stack = self.by_room[room]
        members = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        return members, room

    def bins(self) -> Bins:
        return [b for stack in self.by_room for b in stack if b]


def best_fit(sizes: list[int], items: list[int], capacity: int, kept: Bins = ()) -> Bins:
    """Add ``items``, in the order given, to the ``kept`` bins (which are copied)."""
    rooms = Rooms(capacity)
    for members in kept:
        rooms.put(list(members), capacity - sum(sizes[i] for i in members))
    for i in items:
        members, room = rooms.best(sizes[i])
        members.append(i)
        rooms.put(members, room - sizes[i])
    return rooms.bins()


def fitness(sizes: list[int], bins: Bins, capacity: int) -> float:
    """Mean square fill; more for fewer bins and for uneven rooms."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def crossover(sizes: list[int], one: Bins, other: Bins, capacity: int, chance: random.Random) -> Bins:
    """Inject well-filled bins of ``other`` into ``one``; best-fit what that displaces."""
    full = sorted(range(len(other)), key=lambda b: -sum(sizes[i] for i in other[b]))
    start = chance.randrange(max(1, len(full) // 2))
    injected = [other[b] for b in full[start:start + max(1, len(full) // 5)]]
    taken = {i for b in injected for i in b}
    kept, loose = list(injected), []
    for members in one:
        if taken.isdisjoint(members):
            kept.append(members)
        else:
            loose += [i for i in members if i not in taken]
    return best_fit(sizes, sorted(loose, key=lambda i: (-sizes[i], i)), capacity, kept)


def mutate(sizes: list[int], bins: Bins, capacity: int, chance: random.Random, part: float = 0.05) -> Bins:
    """Empty a few of the poorest bins and some at random, and best-fit their pieces."""
    order = sorted(range(len(bins)), key=lambda b: sum(sizes[i] for i in bins[b]))
    n = max(2, int(len(bins) * part))
    gone = {*order[:n // 2 + 1], *(chance.randrange(len(bins)) for _ in range(n // 2))}
    loose = sorted((i for b in gone for i in bins[b]), key=lambda i: (-sizes[i], i))
    return best_fit(sizes, loose, capacity, [b for k, b in enumerate(bins) if k not in gone])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[Bins], population: int = 5,
           generations: int = 8) -> Bins:
    """The best individual after some generations; never worse than best fit in falling size."""
    chance = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    floor = -(-sum(sizes) // capacity)
    people = [best_fit(sizes, falling, capacity), *elites]
    while len(people) < population:
        noise = [sizes[i] * chance.uniform(0.9, 1.1) for i in range(len(sizes))]
        people.append(best_fit(sizes, sorted(falling, key=lambda i: -noise[i]), capacity))
    rate = lambda bins: (-len(bins), fitness(sizes, bins, capacity))
    ranked = sorted(((rate(p), k, p) for k, p in enumerate(people)), reverse=True)
    born = len(ranked)
    for _ in range(generations):
        if -ranked[0][0][0] <= floor:
            break
        children = []
        for _ in range(population // 2):
            a, b = (min(chance.randrange(len(ranked)), chance.randrange(len(ranked))) for _ in range(2))
            child = crossover(sizes, ranked[a][2], ranked[b][2], capacity, chance)
            if chance.random() < 0.5:
                child = mutate(sizes, child, capacity, chance)
            children.append((rate(child), born, child))
            born += 1
        ranked = sorted([*ranked, *children], reverse=True)[:population]
    return ranked[0][2]


def _bins_of(column: pd.Series) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(column.tolist()):
        groups.setdefault(int(b), []).append(i)
    return list(groups.values())


def _evolver(capacity: int, epoch: int):
    def evolved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable", ignore_index=True)
        sizes = pdf["length"].tolist()
        elites = [_bins_of(pdf[c]) for c in ("own", "migrant") if pdf[c].iloc[0] >= 0]
        seed = int(pdf["block"].iloc[0]) * 1_000_003 + int(pdf["island"].iloc[0]) * 101 + epoch
        bins = evolve(sizes, capacity, seed, elites)
        bin_of, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for b, members in enumerate(bins):
            bin_of[members] = b
            fill[members] = sum(sizes[i] for i in members)
        return pd.DataFrame({"rid": pdf["rid"], "length": pdf["length"], "block": pdf["block"],
                             "island": pdf["island"], "own": bin_of, "filled": fill, "n_bins": len(bins),
                             "fit": fitness(sizes, bins, capacity)})

    return evolved


def _round(scratch: Scratch, items: DataFrame, n_items: int, label: str, capacity: int, block_items: int,
           islands: int, epochs: int) -> DataFrame:
    """Pack (rid, length) rows; returns (rid, length, block, bin, filled)."""
    blocks = max(1, -(-n_items // block_items))
    state = items.select(
        "rid", "length", F.pmod(F.xxhash64("rid", F.lit(label)), F.lit(blocks)).alias("block"),
        F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"),
        F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("migrant"))
    for epoch in range(epochs):
        best = scratch.store(state.groupBy("block", "island").applyInPandas(
            _evolver(capacity, epoch), "rid long, length long, block long, island int, own long, filled long, n_bins long, fit double"),
            f"{label}-{epoch}")
        if epoch:
            scratch.drop(f"{label}-{epoch - 1}")
        moved = best.select("rid", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                            F.col("own").alias("migrant"))
        state = best.select("rid", "length", "block", "island", "own").join(moved, ["rid", "island"])
    # One row for each block.
    winner = best.groupBy("block").agg(F.min_by("island", F.struct("n_bins", -F.col("fit"), "island")).alias("island"))
    return best.join(winner, ["block", "island"]).select("rid", "length", "block", F.col("own").alias("bin"), "filled")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
         end_id: int = 0, block_items: int = 4096, islands: int = 2, epochs: int = 2, poor: float = 0.995) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and place there."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, id_col, text_col, path or tokenizer_path(), limit, end_id)
    cut = scratch.store(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    loose = cut.filter(F.col("length") < limit).select("rid", "length")
    settled, n_items, turn, bins_before = [], loose.count(), 0, None
    while n_items:
        label = f"round{turn}"
        packed = scratch.store(_round(scratch, loose, n_items, label, limit, block_items, islands, epochs), label)
        scratch.drop(f"{label}-{epochs - 1}")
        poorly = F.col("filled") < poor * limit
        left = packed.filter(poorly).agg(
            F.count("*").alias("n"), F.count_distinct("block", "bin").alias("bins"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("ids")).first()
        last = n_items <= block_items or not left["n"] or turn >= 8 or left["bins"] <= -(-left["ids"] // limit) or (
            bins_before is not None and left["bins"] > 0.9 * bins_before)
        named = F.lit(turn) * F.lit(1 << 56) + F.col("block") * F.lit(1 << 24) + F.col("bin")
        done = packed if last else packed.filter(~poorly)
        settled.append(done.select("rid", named.alias("sequence_id")))
        if last:
            break
        loose, n_items, bins_before, turn = packed.filter(poorly).select("rid", "length"), left["n"], left["bins"], turn + 1
    whole = cut.filter(F.col("length") >= limit).select(
        *cut.columns, (F.lit(1 << 62) + F.col("rid")).alias("sequence_id"))
    out = whole
    for part in settled:
        out = out.unionByName(cut.join(part, "rid").select(*whole.columns))

    def placed(batches):
        # Rows of a sequence are neighbours: a running sum that starts anew with each sequence.
        last, at = None, 0
        for batch in batches:
            offsets = []
            for sequence, length in zip(batch.column("sequence_id").to_pylist(), batch.column("length").to_pylist()):
                at = at if sequence == last else 0
                offsets.append(at)
                last, at = sequence, at + length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id")),
                 pa.array(offsets, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (out.repartition("sequence_id").sortWithinPartitions("sequence_id", "rid")
            .mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                "sequence_id long, offset long"))
