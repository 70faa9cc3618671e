"""Secret scans by a linear-chain conditional random field (operator 9).

Tokens are runs of ASCII letters, digits and ``+/_.-``; any other printing character is a
token of its own, except that runs of characters beyond ASCII count as one. Each token
has categorical features: its own shape (length, case, share of digits, hexadecimal or
not), the shapes of its neighbours, hashed identities of itself and the three tokens
before, and features of the whole file. The chain tags tokens as outside, begin or inside;
weights and transitions are learnt here by maximum likelihood (forward-backward, full
batches) from windows tagged by the base patterns: of all windows around base spans and of all
distinct texts' windows at a hashed place, those of the smallest hash, a bounded number of each.

Decoding is Viterbi over whole texts. A token whose ``outside`` score leads by more than any
transition can repay is outside on the best path whatever its neighbours are; the chains
between such tokens are independent, so only they are decoded step by step.

The base patterns' spans are always reported; the chain adds spans that overlap none of
them, under the kind ``crf``. Null and empty texts have no spans.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, code_points, kept

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = 0, 1, 2
#: Training windows of each sort, at most.
SAMPLE_WINDOWS = 2_000
WINDOW = 24
#: Texts whose tokens are held at a time.
AT_ONCE = 200
SHAPES, HASHES, FILES = 1024, 4096, 32
SIZES = (SHAPES, SHAPES, SHAPES, SHAPES, HASHES, HASHES, HASHES, HASHES, FILES)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the value) of the base patterns' matches."""
    raw = text.encode("utf-8").lower()
    found = []
    if any(k in raw for k in KEYWORDS):
        found += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in raw:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def _class_table() -> np.ndarray:
    """Per ASCII code: 0 space, 1 lower, 2 upper, 3 digit, 4 word sign, 5 other; 6 beyond ASCII."""
    table = np.full(129, 5, np.uint8)
    table[[*range(0x21), 0x7F]] = 0
    table[ord("a"):ord("z") + 1] = 1
    table[ord("A"):ord("Z") + 1] = 2
    table[ord("0"):ord("9") + 1] = 3
    table[[ord(c) for c in "+/_.-"]] = 4
    table[128] = 6
    return table


CLASSES = _class_table()


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # per document, its first token (n + 1)
    features: np.ndarray  # feature x token


def tokenize(points: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of all documents of a batch, with features."""
    n = len(points)
    kind = CLASSES[np.minimum(points, 128)]
    word = (kind >= 1) & (kind <= 4)
    group = np.where(word, 1, np.where(kind == 6, 2, 0)).astype(np.int8)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets[:-1]] = True
    fresh = fresh[:n]
    before = np.concatenate([[0], group[:-1]]) if n else group
    begins = ((kind != 0) & ((group == 0) | (group != before) | fresh))
    start = np.flatnonzero(begins)
    # A token ends where the next begins or a space or document boundary comes first.
    stop = np.flatnonzero((kind == 0) | begins | fresh)
    at = np.searchsorted(stop, start, "right")
    end = np.concatenate([stop, [n]])[at] if n else start
    length = end - start
    doc = np.searchsorted(offsets, start, "right") - 1

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[end] - total[start]

    digits, lower, upper = share(kind == 3), share(kind == 1), share(kind == 2)
    hexes = share((kind == 3) | ((kind == 1) & (points <= ord("f"))))
    size = np.searchsorted([4, 8, 12, 16, 20, 32, 64], length, "right")
    ratio = np.where(digits == 0, 0, np.where(4 * digits < length, 1, np.where(2 * digits < length, 2, 3)))
    case = (lower > 0) + 2 * (upper > 0)
    shape = (((size * 4 + ratio) * 4 + case) * 2 + (hexes == length)) * 2 + (digits + lower + upper < length)
    sign = kind[start] if len(start) else kind[:0]
    punctuation = 512 + (points[start] % 256).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    shape = np.where(sign == 5, punctuation, np.where(sign == 6, 900 + size, shape))

    # Hash of a token: sums of code points times powers, with upper case folded.
    folded = (points + np.where(kind == 2, 32, 0)).astype(np.uint64)
    spread = folded * folded * np.uint64(0x9E3779B97F4A7C15) + folded
    place = np.arange(n, dtype=np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
    weighted = np.concatenate([[np.uint64(0)], np.cumsum(spread * place.astype(np.uint64), dtype=np.uint64)])
    plain = total[end] - total[start]
    by_place = weighted[end] - weighted[start] - plain * start.astype(np.uint64)
    mixed = (plain ^ (by_place * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xBF58476D1CE4E5B9)
    name = 1 + (mixed >> np.uint64(32)).astype(np.int64) % (HASHES - 1)

    first = np.searchsorted(start, offsets)
    rank = np.arange(len(start)) - first[doc]
    left = first[doc + 1] - first[doc] - rank if len(start) else rank

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        if by > 0 and len(values) > by:
            out[by:] = np.where(rank[by:] >= by, values[:-by], 0)
        elif by < 0 and len(values) > -by:
            out[:by] = np.where(left[:by] > -by, values[-by:], 0)
        return out

    chars = np.maximum(np.diff(offsets), 1)
    per = np.concatenate([[0], np.cumsum(kind == 3)])
    dense = np.searchsorted([0.002, 0.01, 0.05], (per[offsets[1:]] - per[offsets[:-1]]) / chars, "right")
    signs = np.concatenate([[0], np.cumsum(kind == 5)])
    marked = np.searchsorted([0.02, 0.1], (signs[offsets[1:]] - signs[offsets[:-1]]) / chars, "right")
    long_file = (chars > 2000).astype(np.int64)
    file = ((dense * 3 + marked) * 2 + long_file)[doc] if len(start) else np.zeros(0, np.int64)
    features = np.stack([shape, shifted(shape, 1), shifted(shape, 2), shifted(shape, -1),
                         name, shifted(name, 1), shifted(name, 2), shifted(name, 3), file])
    return Tokens(start, end, doc, first, features)


@dataclass
class Chain:
    weights: list[np.ndarray]  # per feature: value x tag
    moves: np.ndarray  # tag before (3 is the start) x tag

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros((features.shape[1], 3))
        for table, values in zip(self.weights, features):
            total += table[values]
        return total

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens; ``first`` says where each document's tokens begin."""
        n = features.shape[1]
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = self.emissions(features)
        moves = self.moves
        after = np.concatenate([moves[:3], np.zeros((3, 1))], axis=1)  # the end costs nothing
        gain = max(float((moves[:, y, None] + after[y] - moves[:, OUT, None] - after[OUT]).max()) for y in (BEGIN, INSIDE))
        active = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE]) <= max(gain, 0.0)
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        places = np.flatnonzero(active)
        if not len(places):
            return tags
        breaks = np.flatnonzero((np.diff(places) > 1) | opens[places[1:]]) + 1
        for run in np.split(places, breaks):
            start, end = int(run[0]), int(run[-1]) + 1
            best = score[start] + moves[3 if opens[start] else OUT]
            back = []
            for place in range(start + 1, end):
                options = best[:, None] + moves[:3]
                back.append(options.argmax(axis=0))
                best = options.max(axis=0) + score[place]
            if not opens[end]:
                best = best + moves[:3, OUT]
            tag = int(best.argmax())
            for place in range(end - 1, start, -1):
                tags[place] = tag
                tag = int(back[place - start - 1][tag])
            tags[start] = tag
        return tags


def gold_tags(tokens: Tokens, doc: int, spans: list[tuple[int, int, int, int]], origin: int) -> np.ndarray:
    """Tags of one document's tokens after the base spans' values; ``origin`` is where its text begins."""
    a, b = tokens.first[doc], tokens.first[doc + 1]
    start, end = tokens.start[a:b] - origin, tokens.end[a:b] - origin
    tags = np.zeros(b - a, np.int8)
    for _, _, to, value in spans:
        inside = np.flatnonzero((start < to) & (end > value))
        if len(inside):
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
    return tags


def train(features: np.ndarray, tags: np.ndarray, mask: np.ndarray, rounds: int = 60, rate: float = 0.5,
          ridge: float = 1e-3) -> Chain:
    """Maximum likelihood of windows (feature x window x place); Adagrad on the full batch."""
    weights = [np.zeros((size, 3)) for size in SIZES]
    moves = np.zeros((4, 3))
    chain = Chain(weights, moves)
    n_windows, width = tags.shape
    if not n_windows:
        weights[0][:, OUT] = 5.0
        return chain
    gold = np.zeros((n_windows, width, 3))
    np.put_along_axis(gold, tags[..., None].astype(np.int64), 1.0, axis=2)
    gold *= mask[..., None]
    flat = features.reshape(len(SIZES), -1)
    pair = np.zeros((4, 3))
    pair[3] = gold[:, 0].sum(axis=0)
    for t in range(1, width):
        pair[:3] += gold[:, t - 1].T @ gold[:, t]
    memory = [np.full_like(w, 1e-2) for w in weights] + [np.full_like(moves, 1e-2)]
    for _ in range(rounds):
        score = chain.emissions(flat).reshape(n_windows, width, 3)
        forward = np.empty_like(score)
        backward = np.zeros_like(score)
        forward[:, 0] = score[:, 0] + moves[3]
        for t in range(1, width):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[None, :3], axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None, :3] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        miss = gold - chance
        expected = np.zeros((4, 3))
        expected[3] = chance[:, 0].sum(axis=0)
        for t in range(1, width):
            both = (forward[:, t - 1, :, None] + moves[None, :3] + (score[:, t] + backward[:, t])[:, None, :]
                    - total[:, None, None])
            expected[:3] += (np.exp(both) * mask[:, t, None, None]).sum(axis=0)
        slopes = []
        for table, values in zip(weights, flat):
            slope = np.stack([np.bincount(values, miss[..., y].ravel(), len(table)) for y in range(3)], axis=1)
            slopes.append(slope / n_windows - ridge * table)
        slopes.append((pair - expected) / n_windows - ridge * moves)
        for table, slope, seen in zip([*weights, moves], slopes, memory):
            seen += slope * slope
            table += rate * slope / np.sqrt(seen)
    return chain


def _span_orders(order: int, n: int) -> np.ndarray:
    """Hashes of a text's base spans, by which their windows are drawn."""
    mixed = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(order & (1 << 64) - 1)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(by))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


class _Least:
    """The ``most`` smallest distinct (order, text, nth) of those added."""

    def __init__(self, most: int):
        self.most, self.heap, self.held = most, [], set()

    def add(self, order: int, text: int, nth: int) -> None:
        row = (-order, text, nth)
        if row in self.held or (len(self.heap) >= self.most and row <= self.heap[0]):
            return
        self.held.add(row)
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, row)
        else:
            self.held.discard(heapq.heappushpop(self.heap, row))

    def full_at(self) -> int | None:
        """The largest order held, once no larger one can enter."""
        return -self.heap[0][0] if len(self.heap) >= self.most else None


def _candidates(batches):
    """Of each sort, a task's windows of the smallest hash: (sort, order, hash of the text, which base span)."""
    kept("secrets")
    found = [_Least(SAMPLE_WINDOWS), _Least(SAMPLE_WINDOWS)]
    for batch in batches:
        for text, order in zip(batch.column("text").to_pylist(), batch.column("order").to_pylist()):
            found[0].add(order, order, -1)
            spans = base_spans(text)
            if spans:
                keys = _span_orders(order, len(spans))
                limit = found[1].full_at()
                for nth in np.flatnonzero(keys <= limit) if limit is not None else range(len(keys)):
                    found[1].add(int(keys[nth]), order, int(nth))
    rows = [(sort, -least, text, nth) for sort in (0, 1) for least, text, nth in found[sort].heap]
    columns = list(zip(*rows)) if rows else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32()))],
                                     names=["sort", "order", "text", "nth"])


def _window_cutter(sent):
    """Cut the chosen windows; a text that occurs again in the task is passed over."""
    schema = pa.schema([("sort", pa.int32()), ("order", pa.int64()), ("tags", pa.list_(pa.int32())),
                        ("features", pa.list_(pa.int32()))])

    def cut(batches):
        kept("secrets")
        chosen, done = sent.value, set()
        for batch in batches:
            fresh = []
            for i, order in enumerate(batch.column("order").to_pylist()):
                if order in chosen and order not in done:
                    done.add(order)
                    fresh.append(i)
            for at in range(0, len(fresh), AT_ONCE):
                some = batch.take(pa.array(fresh[at:at + AT_ONCE], pa.int64()))
                points, offsets = code_points(some.column("text"))
                tokens = tokenize(points, offsets)
                rows = []
                for i, (text, order) in enumerate(zip(some.column("text").to_pylist(), some.column("order").to_pylist())):
                    a, b = int(tokens.first[i]), int(tokens.first[i + 1])
                    if a == b:
                        continue
                    spans = base_spans(text)
                    tags = gold_tags(tokens, i, spans, int(offsets[i]))
                    for sort, key, nth in chosen[order]:
                        # The token that a span's value begins in, or a hashed one.
                        spot = (int(np.searchsorted(tokens.end[a:b], int(offsets[i]) + spans[nth][3], "right"))
                                if sort else key % (b - a))
                        start = max(0, min(spot - (key >> 20) % (WINDOW - 4), b - a - WINDOW))
                        part = tokens.features[:, a + start:a + min(start + WINDOW, b - a)]
                        rows.append({"sort": sort, "order": key, "tags": tags[start:start + WINDOW].tolist(),
                                     "features": part.ravel().tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cut


def _windows(docs: DataFrame):
    """Training windows: around base spans of any text, and at a hashed place of distinct texts.

    All texts are looked at. First only hashes are passed on, the smallest ``SAMPLE_WINDOWS`` of each
    sort from a task; then the windows of the smallest of all are cut. Equal texts count once.
    """
    spark = docs.sparkSession
    texts = (docs.filter(F.col("text").rlike(r"[^\x00-\x20\x7F]"))
             .select("text", F.xxhash64("text").alias("order")))
    scratch = Scratch(spark, "secrets")
    found = scratch.store(texts.mapInArrow(_candidates, "sort int, order long, text long, nth int"), "candidates")
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for sort in (0, 1):
        for r in found.filter(F.col("sort") == sort).distinct().orderBy("order", "text", "nth").limit(SAMPLE_WINDOWS).collect():
            chosen.setdefault(r["text"], []).append((sort, r["order"], r["nth"]))
    scratch.drop("candidates")
    rows = []
    if chosen:
        # At most two lists of SAMPLE_WINDOWS hashes.
        sent = spark.sparkContext.broadcast(chosen)
        keys = spark.createDataFrame([(k,) for k in chosen], "order long")
        cut = (texts.join(F.broadcast(keys), "order", "left_semi").select("text", "order")
               .mapInArrow(_window_cutter(sent), "sort int, order long, tags array<int>, features array<int>"))
        rows = cut.dropDuplicates(["sort", "order"]).orderBy("sort", "order").collect()
    features = np.zeros((len(SIZES), len(rows), WINDOW), np.int64)
    tags = np.zeros((len(rows), WINDOW), np.int8)
    mask = np.zeros((len(rows), WINDOW), bool)
    for i, row in enumerate(rows):
        size = len(row["tags"])
        features[:, i, :size] = np.array(row["features"]).reshape(len(SIZES), size)
        tags[i, :size], mask[i, :size] = row["tags"], True
    return features, tags, mask


def fit(docs: DataFrame, text_col: str = "text") -> Chain:
    """Learn the chain from a bounded number of windows, drawn from all texts of ``docs``."""
    return train(*_windows(docs.select(F.col(text_col).alias("text"))))


def chain_spans(tokens: Tokens, tags: np.ndarray, doc: int, origin: int) -> list[tuple[int, int]]:
    """Character spans of runs of begin and inside tags in one document."""
    a, b = int(tokens.first[doc]), int(tokens.first[doc + 1])
    out: list[list[int]] = []
    open_ = False
    for i in range(a, b):
        if tags[i] == OUT:
            open_ = False
            continue
        if tags[i] == INSIDE and open_:
            out[-1][1] = int(tokens.end[i]) - origin
        else:
            out.append([int(tokens.start[i]) - origin, int(tokens.end[i]) - origin])
        open_ = True
    return [(s, e) for s, e in out]


def all_spans(text_column, chain: Chain) -> list[tuple[list, list[tuple[int, int, int]]]]:
    """Per document of a batch: base spans, and all spans (kind, start, end) by start, then kind."""
    if len(text_column) > AT_ONCE:
        return [found for at in range(0, len(text_column), AT_ONCE)
                for found in all_spans(text_column.slice(at, AT_ONCE), chain)]
    points, offsets = code_points(text_column)
    tokens = tokenize(points, offsets)
    tags = chain.decode(tokens.features, tokens.first)
    tagged = np.add.reduceat(np.concatenate([tags != OUT, [False]]), np.minimum(tokens.first[:-1], len(tags)))
    tagged = np.where(tokens.first[1:] > tokens.first[:-1], tagged, 0)
    out = []
    for i, text in enumerate(text_column.to_pylist()):
        base = base_spans(text) if text else []
        spans = [(k, s, e) for k, s, e, _ in base]
        if tagged[i]:
            spans += [(3, s, e) for s, e in chain_spans(tokens, tags, i, int(offsets[i]))
                      if not any(s < to and e > at for _, at, to, _ in base)]
        out.append((base, sorted(spans, key=lambda x: (x[1], x[0]))))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def scanned(batches):
        kept("secrets")
        for batch in batches:
            rows = []
            for base, spans in all_spans(batch.column("text"), sent.value):
                own = written([b[:3] for b in base])
                counts = [sum(b[0] == k for b in base) for k in range(3)]
                rows.append((*counts, hashlib.sha256(own.encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, "
                                    "base_sha256 string, spans string")


def redact(docs: DataFrame, chain: Chain, text_col: str = "text", length_col: str | None = None,
           mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark``; ``length_col``, if given, follows the text."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def redacted(batches):
        kept("secrets")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            changed = []
            for i, (_, spans) in enumerate(all_spans(batch.column(at), sent.value)):
                if spans:
                    parts, done = [], 0
                    for _, start, end in spans:
                        if start >= done:
                            parts += [texts[i][done:start], mark]
                        done = max(done, end)
                    texts[i] = "".join(parts) + texts[i][done:]
                    changed.append(i)
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if length_col:
                    place = batch.schema.get_field_index(length_col)
                    lengths = batch.column(place).to_pylist()
                    for i in changed:
                        lengths[i] = len(texts[i])
                    batch = batch.set_column(place, batch.schema.field(place),
                                             pa.array(lengths, batch.schema.field(place).type))
            yield batch

    return docs.mapInArrow(redacted, docs.schema)
