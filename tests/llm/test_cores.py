"""The operators' small cores against brute force, without Spark."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from retentio.llm import (common, decontaminate, jaccard_join, langid, licenses, mixing, order_minhash, packing, secrets,
                          sharding, toxicity)

ODD_TEXTS = [None, "", " \n\t ", "a", "Don't <|endoftext|> x", "áb é CAFÉ µm ªº ×÷ ßÿ", "\x0b\x0c vt a\x0bb c\x85d",
             "123 4a5b6 $$$ !?!  don''t '' I'LL", "İstanbul ΣΣ 你好 \U0001f600 1٢²", "x'tail 's \x00a\x7fb", "word " * 3000]


def test_text_buffers():
    column = pa.array(["", "aé", None, "z"])
    raw, offsets = common.text_buffer(column.slice(1))
    assert raw.tobytes().decode() == "aéz" and offsets.tolist() == [0, 3, 3, 4]
    points, ends = common.code_points(column)
    assert points.tolist() == [ord(c) for c in "aéz"] and ends.tolist() == [0, 0, 2, 2, 3]
    assert common.segment_sums(np.array([1.0, 2.0, 4.0]), np.array([0, 1, 1, 3])).tolist() == [1.0, 0.0, 6.0]


# -- toxicity ---------------------------------------------------------------------------------

def all_maximal(scores):
    """Maximal segments by definition: the best segment, then the same left and right of it."""
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    i, j = where
    return (all_maximal(scores[:i]) + [(i, j, best)]
            + [(a + j, b + j, s) for a, b, s in all_maximal(scores[j:])])


@pytest.mark.parametrize("seed", range(40))
def test_maximal_segments(seed):
    chance = random.Random(seed)
    scores = [chance.choice([-1.0, -1.0, -1.0, 2.3, 1.1, 0.7]) for _ in range(chance.randrange(1, 25))]
    hits = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.maximal_segments(hits, [scores[i] for i in hits], 1.0)
    want = all_maximal(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(x[2], y[2]) for x, y in zip(got, want))


class Counted(float):
    """A float that counts how often it is compared."""
    comparisons = 0

    def __ge__(self, other):
        Counted.comparisons += 1
        return float(self) >= float(other)

    def __add__(self, other):
        return Counted(float(self) + float(other))

    def __sub__(self, other):
        return Counted(float(self) - float(other))

    __radd__ = __add__


@pytest.mark.parametrize("gap, score", [(12, 2.0), (3, 2.0), (8, 2.0)])
def test_maximal_segments_are_found_in_linear_time(gap, score):
    cost = {}
    for n in (2_000, 4_000, 8_000):
        Counted.comparisons = 0
        found = toxicity.maximal_segments(range(0, gap * n, gap), [Counted(score)] * n, 0.25)
        assert len(found) == (n if gap == 12 else 1)
        cost[n] = Counted.comparisons
    assert 0 < cost[4_000] <= 2.1 * cost[2_000] and cost[8_000] <= 2.1 * cost[4_000] and cost[8_000] <= 8 * 8_000


def test_maximal_segments_of_mixed_scores_in_linear_time():
    chance = random.Random(7)
    scores = [chance.choice([0.3, 1.0, 2.6, 5.0]) for _ in range(20_000)]
    places = sorted(chance.sample(range(200_000), 20_000))
    Counted.comparisons = 0
    toxicity.maximal_segments(places, [Counted(s) for s in scores], 0.25)
    assert 0 < Counted.comparisons <= 8 * 20_000


def test_lambda_solves_its_equation():
    scores, shares = np.array([2.0, 4.0]), np.array([0.01, 0.002])
    lam = toxicity.solve_lambda(scores, shares, 0.25)
    assert math.isclose((shares * np.exp(lam * scores)).sum() + (1 - shares.sum()) * math.exp(-lam * 0.25), 1, abs_tol=1e-9)


# -- decontamination --------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(60))
def test_automaton_finds_every_window(seed):
    chance = random.Random(seed)
    window = chance.choice([2, 3, 4])
    letters = [b"a", b"b", b"c"]
    items = [(str(k), [chance.choice(letters) for _ in range(chance.randrange(0, 9))]) for k in range(chance.randrange(0, 5))]
    words = [chance.choice([*letters, b"x"]) for _ in range(30)]
    hit, found = set(), set()
    for name, item in items:
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if item else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == item[i:i + size]:
                    hit.update(range(j, j + size))
                    found.add(name)
    automaton = decontaminate.SuffixAutomaton(items, window)
    spans, names, _ = automaton.scan(words)
    assert {p for s, e in spans for p in range(s, e)} == hit
    assert {automaton.names[i] for i in names} == found


def test_blocks_cover_every_window():
    text = " ".join(f"w{i}" for i in range(57))
    blocks = decontaminate.blocks_of([("a", text), ("b", "one two"), ("c", None)], 10, 20)
    assert all(sum(len(w) for _, w in b) <= 20 for b in blocks)
    windows = {tuple(w[i:i + 10]) for b in blocks for n, w in b if n == "a" for i in range(len(w) - 9)}
    assert len(windows) == 48


def test_removed_spans():
    assert decontaminate.remove_spans("Aa, bb. Cc dd!", [(1, 3)]) == "Aa, \n dd!"


# -- Jaccard ----------------------------------------------------------------------------------

def test_shingle_sets():
    sets = jaccard_join.shingle_sets(pa.array([None, "", "  ", "A b", "a\tB ", "a b c d e f", "a b c d e a b c d e"]), 5)
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 2, 5]
    assert sets[3][0] == sets[4][0] != sets[5][0]


@pytest.mark.parametrize("seed", range(30))
def test_linked_sets_share_a_key(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    one = rng.choice(1 << 20, n, replace=False).astype(np.uint64)
    other = np.concatenate([one[int(rng.integers(0, n // 8 + 1)):], rng.choice(1 << 20, int(rng.integers(0, 4))).astype(np.uint64) + np.uint64(1 << 21)])
    one, other = np.sort(one), np.unique(other)
    shared = len(np.intersect1d(one, other))
    common_ = np.sort(rng.choice(one, max(n // 3, 1), replace=False))
    counts = rng.integers(1, 9, len(common_))
    linked = 100 * shared >= 80 * (len(one) + len(other) - shared) and not np.array_equal(one, other)
    for boundary in (1, 10, 25, 200):
        a = jaccard_join.keys_of(one, common_, counts, 80, boundary)
        b = jaccard_join.keys_of(other, common_, counts, 80, boundary)
        if linked and a and b:
            least = int(jaccard_join.least_overlap(np.array(len(one)), np.array(len(other)), 80))
            mosts = {k: m for k, m in zip(b[0].tolist(), b[2].tolist())}
            assert any(k in mosts and min(m, mosts[k]) >= least for k, m in zip(a[0].tolist(), a[2].tolist()))


def test_sketch_bounds_the_overlap():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(2))
    b[:150] = a[:150]
    x, y = (np.frombuffer(jaccard_join.sketch(s), np.uint8).astype(int) for s in (a, b))
    assert np.minimum(x, y).sum() >= 150
    assert jaccard_join.sketch(np.zeros(300, np.uint64)) == b""


# -- secrets ----------------------------------------------------------------------------------

def test_tokens_equal_a_pattern():
    texts = [t or "" for t in ODD_TEXTS] + ['token = "ab12"; x=1\ny']
    points, offsets = common.code_points(pa.array(texts))
    tokens = secrets.tokenize(points, offsets)
    for i, text in enumerate(texts):
        a, b = tokens.first[i], tokens.first[i + 1]
        got = [text[s - offsets[i]:e - offsets[i]] for s, e in zip(tokens.start[a:b], tokens.end[a:b])]
        assert got == re.findall(r"[A-Za-z0-9+/_.\-]+|[\u0080-\U0010ffff]+|[^\x00-\x20\x7f]", text)


def test_decoding_is_viterbi():
    rng = np.random.default_rng(3)
    chain = secrets.Chain([rng.normal(size=(s, 3)) * (2 if k == 0 else 0.1) for k, s in enumerate(secrets.SIZES)],
                          rng.normal(size=(4, 3)))
    for _ in range(20):
        sizes = rng.integers(0, 6, 3)
        n = int(sizes.sum())
        features = np.stack([rng.integers(0, s, n) for s in secrets.SIZES]) if n else np.zeros((9, 0), int)
        first = np.concatenate([[0], np.cumsum(sizes)])
        got = chain.decode(features, first)
        score = chain.emissions(features)
        for a, b in zip(first[:-1], first[1:]):
            def worth(path):
                total, last = 0.0, 3
                for place, tag in zip(range(a, b), path):
                    total += score[place, tag] + chain.moves[last, tag]
                    last = tag
                return total
            best = max((worth(p) for p in itertools.product(range(3), repeat=int(b - a))), default=0.0)
            assert math.isclose(worth(got[a:b].tolist()), best, abs_tol=1e-9)


def test_base_spans():
    text = 'TOKEN="abc" secret: abcdefg api-key=zzzzzzz api_key=1234567 AKIA' + "Z" * 16 + " AKIAZZ " + "0" * 24 + " " + "f" * 23
    found = [(secrets.KINDS[k], text[s:e]) for k, s, e, _ in secrets.base_spans(text)]
    assert found == [("assign", "secret: abcdefg"), ("assign", "api_key=1234567"), ("access", "AKIA" + "Z" * 16), ("hex", "0" * 24)]
    assert secrets.base_spans("secret=token =abcdefgh") == []  # a failing match still takes its place


# -- fingerprints -----------------------------------------------------------------------------

def test_signatures():
    chance = random.Random(5)
    text = "".join(chance.choice("abcdefgh ") for _ in range(3000))
    same, near = order_minhash.signature(text), order_minhash.signature(text[:1500] + "q" + text[1500:])
    far = order_minhash.signature("".join(chance.choice("abcdefgh ") for _ in range(3000)))
    assert (same == order_minhash.signature(str(text))).all()
    assert order_minhash.likeness(same, near) > 0.8 > 0.1 > order_minhash.likeness(same, far)
    # Moving whole parts keeps the k-mers but not their order.
    moved = order_minhash.signature(text[1500:] + text[:1500])
    assert 0.2 < order_minhash.likeness(same, moved) < 0.8
    for short in ("", "a", "abc", "aaaaaaaaaaaa", "é" * 70):
        assert len(order_minhash.signature(short)) == order_minhash.ENTRIES


# -- packing ----------------------------------------------------------------------------------

def test_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(ODD_TEXTS, pa.string()))
        for i, text in enumerate(ODD_TEXTS):
            want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids[offsets[i]:offsets[i + 1]].tolist() == want


@pytest.mark.parametrize("seed", range(8))
def test_evolution_keeps_all_pieces(seed):
    chance = random.Random(seed)
    sizes = [chance.randrange(1, 100) for _ in range(chance.randrange(1, 120))]
    bins = packing.evolve(sizes, 100, seed, [])
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    assert len(bins) <= len(packing.best_fit(sizes, falling, 100))
    child = packing.crossover(sizes, bins, packing.best_fit(sizes, list(range(len(sizes))), 100), 100, chance)
    assert sorted(i for b in child for i in b) == list(range(len(sizes)))


# -- the other cores --------------------------------------------------------------------------

def test_ranges():
    cuts = [(5, -9, 0), (7, -9, 0), (7, 3, 1), (9, -9, 0)]
    rows = [(4, 0, 0), (5, 0, 0), (7, 3, 0), (7, 3, 1), (8, 0, 0), (9, 9, 9)]
    got = sharding.range_of(*(np.array(c) for c in zip(*rows)), cuts)
    assert got.tolist() == [sum(c <= r for c in cuts) for r in rows]


def test_license_places():
    chance = random.Random(2)
    words = ["mit", "license", "apache", "general", "public", "x", "mit"]
    index = licenses.build_index({b"license": 5}, 10)
    for _ in range(300):
        text = [chance.choice(words).encode() for _ in range(chance.randrange(0, 14))]
        want = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(text))
                      if text[i:i + len(phrase.split())] == phrase.encode().split())
        assert licenses.scan(text, index)[0] == want
    assert licenses.scan(b"licensed under cc by nc 4 0".split(), index)[1] == {"cc-by-nc": 1.0}


def test_ngrams_stay_inside_their_text():
    column = pa.array(["ab", None, "c1 d", ""])
    counts = [int(valid.sum()) for _, valid, _ in langid.hashed_ngrams(column, 16, 3)]
    assert counts == [4, 3, 2]  # only runs that hold a letter: a b c d; ab, c1, ' d'; 'c1 ', '1 d'


def test_codes_are_complete():
    raw, offsets = common.text_buffer(pa.array(["abba cab", "", "a b"]))
    pairs, triples = mixing.symbol_counts(raw, offsets)
    assert pairs.sum() == triples[1].sum() == 8 + 0 + 3 + 3 and pairs[0, ord("a")] == 2 and pairs[0, mixing.END] == 1
    code = mixing.build_code(pairs, np.concatenate([triples, [[ord("a") << 16 | ord("b") << 8 | 99], [500]]], axis=1))
    assert code.which[ord("a") << 8 | ord("b")] == len(code.size) // 256 - 1
    for before in (0, ord("a"), ord("z"), ord("a") << 8 | ord("b"), ord("c") << 8 | ord("b")):
        own = slice(code.which[before] * 256, code.which[before] * 256 + 256)
        assert math.isclose(sum(2.0 ** -s for s in code.size[own].tolist()), 1.0)
        paths = {tuple(code.path[a:a + n].tolist()) for a, n in zip(code.start[own], code.size[own])}
        assert len(paths) == 256  # every symbol's path is its own


def test_texts_are_scored_alone():
    rng = np.random.default_rng(0)
    tables = [np.zeros(2 << b, np.uint32) for b in mixing.SLOT_BITS]
    texts = ["the cat sat on the mat. " * 30, "", "x", "the dog sat on the cat. " * 40]
    raw, offsets = common.text_buffer(pa.array(texts))
    pairs, triples = mixing.symbol_counts(raw, offsets)
    code = mixing.build_code(pairs, triples)
    mixing.count(code, raw, offsets, tables)
    # Each choice is counted once in each table.
    choices = sum(code.size[code.which[k >> 8] * 256 + (k & 255)] * n for k, n in triples.T.astype(np.int64).tolist())
    assert all(t.sum() == choices for t in tables)
    mixer = mixing.fit_mixer(code, tables, raw, offsets)
    maps = mixing.stretched(tables)
    together = mixing.score(code, mixer, maps, raw, offsets)
    alone = [mixing.score(code, mixer, maps, *common.text_buffer(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-5) and (together > 0).all()
    noise = "".join(chr(c) for c in rng.integers(33, 90, 700))
    assert mixing.score(code, mixer, maps, *common.text_buffer(pa.array([noise])))[0] / 700 > 4 > together[0] / 720


def test_log_odds_of_the_other_choices():
    counts = np.array([0, 0, 1, 0, 0, 1, 3, 5, 1, 1, 4000, 1], np.uint32)
    got = mixing.others_log_odds(counts)
    odds = lambda none, one: mixing.whole_log_odds(np.array([none], np.uint32), np.array([one], np.uint32))[0]
    for slot, (none, one) in enumerate(counts.reshape(-1, 2).tolist()):
        assert got[2 * slot] == odds(max(none - 1, 0), one)
        assert got[2 * slot + 1] == odds(none, max(one - 1, 0))
