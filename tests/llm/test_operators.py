"""The operators on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retentio.llm import (common, components, decontaminate, jaccard_join, langid, language_model, licenses,
                          order_minhash, packing, secrets, sharding, toxicity)
from retentio.llm.common import Scratch, fold, prepare

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, shard string, key string, "
          "word string, n int, part int, class string, component string")


def frame(spark, rows):
    """Documents with further columns, whose names the operators use themselves."""
    prepare(spark)
    full = [(i, t, lang, "s", len(t or ""), 0.5, "x", "k", "w", 1, 2, "c", "d") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus():
    chance = random.Random(7)
    english = ["the", "and", "thing", "with", "shall", "over", "house", "water", "thought", "which"]
    german = ["der", "und", "nicht", "über", "schön", "haus", "wasser", "gedanke", "welche", "straße"]
    rows = []
    for i in range(120):
        words = english if i % 3 else german
        text = " ".join(chance.choice(words) for _ in range(chance.randrange(8, 60)))
        rows.append((i, text, "en" if i % 3 else "de"))
    rows += [(500, None, "en"), (501, "", None), (502, " \n ", "de"), (None, "the thing", "en"), (503, "word " * 4000, "en"),
             (504, "12 34 !?", "en"), (3, rows[3][1], rows[3][2]), (505, rows[3][1], "en")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def test_toxicity(spark, nothing):
    chance = random.Random(1)
    calm = ["tree", "river", "stone", "cloud", "grass", "field"]
    rows, labels = [], []
    for i in range(400):
        words = [chance.choice(calm) + chance.choice(["", "s", "y"]) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[5:8] = [chance.choice(["nastyword", "vileword", "foulword"]) for _ in range(3)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic) if i % 50 else 1 - int(toxic)))
    rows += [(900, None, None), (901, "", None), (None, "nastyword vileword foulword", None), (902, "tree " * 20000, None)]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (901, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter(fold(F.col("doc_id")) != 0))
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    truth = {i: int(i % 4 == 0) for i in range(400)}
    known = got[got["doc_id"].notna() & (got["doc_id"] < 400)]
    assert all(truth[int(r.doc_id)] == r.predicted for r in known.itertuples())
    assert got.loc[got["doc_id"].isna(), "predicted"].tolist() == [1]
    assert got.loc[got["doc_id"] >= 900, "predicted"].tolist() == [0, 0, 0]
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(b"" if i != i else str(int(i)).encode()) % 5 == 0)).all()
    top = got[got["doc_id"] == 4].iloc[0]
    assert (top.passage_start, top.passage_end) == (5, 8)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == (got["predicted"] == 0).sum()
    # Nothing to learn from, nothing to score.
    empty = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(docs, empty).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_words_without_clean_documents(spark):
    # A word in 1 % of the toxic documents and in no clean one is learnt whatever the number of labelled rows.
    sizes = [4_000, 12_000, 40_000, 400_000]
    for n in sizes:
        n_toxic = n * 11 // 100
        counts = spark.createDataFrame([(n_toxic // 100, c) for c in range(40)], "toxic long, clean long")
        bounds = [r[0] for r in counts.coalesce(1).select(
            toxicity.lower_bound(F.col("toxic"), F.col("clean"), n_toxic, n - n_toxic)).collect()]
        assert bounds[0] > 1.0 and bounds == sorted(bounds, reverse=True)
    never = spark.range(1).select(toxicity.lower_bound(F.lit(0), F.lit(1), 4, 399_996))
    assert never.first()[0] is None
    n = 12_000
    rows = [(i, ("rareslur " if i % 900 == 0 else "vileword " if i % 9 == 0 else "") + "calm river stone", None) for i in range(n)]
    marks = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(n)], "doc_id long, toxic int")
    assert toxicity.fit(frame(spark, rows), marks).score_of("rareslur") > 0


def test_language(docs, nothing):
    model = langid.fit(docs.filter(fold(F.col("doc_id")) != 0))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(docs, model).toPandas().itertuples() if r.doc_id == r.doc_id}
    assert all(got[i].lang_pred == ("en" if i % 3 else "de") and 0.5 < got[i].score <= 1 for i in range(120))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502, 504))
    assert langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_licenses(spark, nothing):
    rows = [(1, "Released under the MIT License. mit\nlicense mit-license", None), (2, None, None), (3, "", None),
            (4, "GNU General Public Licenses", None), (5, "Licensed under CC BY-NC 4.0.", None), (5, "apache license", None),
            (6, "x " * 50_000 + "General public license", None)]
    got = licenses.detect(frame(spark, rows)).toPandas()
    found = sorted(zip(got["doc_id"], got["n_words"], got["n_base"], got["base_labels"], got["labels"]))
    assert found == [(1, 9, 3, "mit", "mit"), (2, 0, 0, "", ""), (3, 0, 0, "", ""), (4, 4, 0, "", ""),
                     (5, 2, 1, "apache", "apache"), (5, 7, 0, "", "cc-by-nc"), (6, 50_003, 1, "gpl", "gpl")]
    first = got.set_index(["doc_id", "n_words"])
    assert (first.loc[(1, 9), "first_word"], first.loc[(1, 9), "last_word"]) == (3, 7)
    assert first.loc[(6, 50_003), "first_word"] == 50_000 and np.isnan(first.loc[(2, 0), "first_word"])
    assert got["score"].between(0, 1).all() and licenses.detect(nothing).count() == 0


def test_secrets(spark, nothing):
    chance = random.Random(3)
    key = lambda: "".join(chance.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"some words é here token = \"{key()}\" and more words" if i % 3 == 0 else "plain words with no key here " * 3, None)
            for i in range(150)]
    rows += [(200, None, None), (201, "", None), (None, "password: hunter2222", None), (0, "x", None)]
    docs = frame(spark, rows)
    chain = secrets.fit(docs)
    got = secrets.scan(docs, chain).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        text = "password: hunter2222" if r.doc_id != r.doc_id else None
        if text is None and r.doc_id < 150 and r.doc_id % 3 == 0 and r.n_hex:
            assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 1) and r.spans.startswith("assign:18:")
        elif text:
            assert r.spans == "assign:0:20" and r.base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest()
        else:
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = secrets.redact(docs, chain, length_col="n_chars")
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert masked.filter(F.col("text").rlike("[0-9a-f]{24}") | (F.length("text") != F.col("n_chars"))).count() == 0
    assert secrets.scan(nothing, secrets.fit(nothing)).count() == 0


def test_secret_windows_come_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE_WINDOWS", 40)
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(i, f"plain words of text number {i} without any key", None) for i in range(30_000)]
    rows += [(40_000 + i, f"first = {key(2 * i)} " + "and more " * 30 + f"then = {key(2 * i + 1)}", None) for i in range(10)]
    rows += [(50_000 + i, f"the copied file says {key('copy')} here", None) for i in range(3_000)]
    rows += [(60_000, None, None), (60_001, " \n", None)]
    features, tags, mask = secrets._windows(frame(spark, rows).select("text"))
    secret = (tags == secrets.BEGIN).any(axis=1)
    # Both spans of each of the ten rare texts, and the copied text once; the others are distinct texts.
    assert secret.sum() == 21 and len(tags) == 61 and mask[:, 0].all()
    assert len({features[:, i].tobytes() for i in range(61)}) == 61


def test_sharding(spark, docs, nothing):
    chance = random.Random(4)
    rows = [(i, "copy of one text" if i % 3 == 0 else "t" * chance.randrange(0, 900), None) for i in range(3000)]
    rows += [(None, None, None), (5000, "z" * 30_000, None), (1, rows[1][1], None), (1, rows[1][1], None)]
    got = sharding.shard(frame(spark, rows), 8).toPandas()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    ids = [None if i != i else int(i) for i in got["doc_id"]]
    assert Counter(zip(ids, got["size"].tolist(), got["text_crc32"].tolist())) == want
    assert set(got["shard"]) == set(range(8)) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * 30_016 and sums.drop(sums.idxmax()).max() < 1.1 * got["size"].sum() / 8 + 30_016
    again = sharding.shard(frame(spark, rows[:3000]), 8).toPandas()
    split = again.groupby("text_crc32")["shard"].nunique()
    assert (split > 1).sum() <= 8
    assert sharding.shard(nothing, 8).count() == 0
    assert sharding.shard(docs, 40).count() == len(corpus())


def test_sharding_leaves_no_range_overfull(spark, monkeypatch):
    # One record holds nearly all bytes and draws every sample by size; the range that it begins has many others.
    found, placed = [], sharding._with_range

    def watched(records, cuts):
        ranges = placed(records, cuts)
        found.append(ranges.groupBy("range_id").agg(F.count("*"), F.sum("size")).collect())
        return ranges

    monkeypatch.setattr(sharding, "_with_range", watched)
    rows = [(i, f"t{i}", None) for i in range(3000)] + [(5000, "z" * 20_000_000, None)]
    got = sharding.shard(frame(spark, rows), 2, ranges_per_shard=4)
    assert got.count() == len(rows)
    assert all(n <= 96 or size <= 3 * 20_000_000 / 8 for _, n, size in found[-1])


def test_packing(docs, nothing):
    encoder = packing.WordEncoder(packing.tokenizer_path())
    got = packing.pack(docs, limit=64, block_items=40).toPandas()
    want = Counter()
    for i, text, _ in corpus():
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, start in enumerate(range(0, len(ids), 64)):
            part = ids[start:start + 64]
            want[i, n, start, len(part), zlib.crc32(part.tobytes())] += 1
    ids = [None if x != x else int(x) for x in got["doc_id"]]
    assert Counter(zip(ids, got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= 1.05 * math.ceil(got["length"].sum() / 64)
    assert packing.pack(nothing).count() == 0


def test_fingerprints(spark, docs, nothing):
    got = order_minhash.half_edited(docs).toPandas()
    rows = corpus()
    assert len(got) == len(rows)
    # Rows that share an id may stand in either order; all others have one place.
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    by_id = Counter(r[0] for r in rows)
    for k, (i, text, _) in enumerate(order):
        following = order[(k + 1) % len(order)]
        if by_id[i] > 1 or by_id[following[0]] > 1:
            continue
        text, other = text or "", following[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        row = got[got["doc_id"].isna()].iloc[0] if i is None else got[got["doc_id"] == i].iloc[0]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == order_minhash.written(order_minhash.signature(text))
        assert row.edited_fingerprint == order_minhash.written(order_minhash.signature(edited))
    assert got["near_edited"].between(0, 1).all() and got["near_edited"].mean() > got["near_next"].mean()
    one = order_minhash.half_edited(frame(spark, [(1, "abcdefgh", None)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest()
    assert order_minhash.half_edited(nothing).count() == 0
    plain = order_minhash.fingerprint(docs).filter("doc_id in (3, 505)")
    assert plain.select("fingerprint").distinct().count() == 1


def test_fingerprints_of_ids_that_are_no_numbers(spark):
    """Ids of another type stand by their text; a null id stands last, after the empty one."""
    texts = {"b2": "the second of the letters", "a10": "ten comes before nine here", "a9": "nine", "": "no name at all", None: "nothing"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(3)
    got = {r["doc_id"]: r for r in order_minhash.half_edited(docs).collect()}
    order = ["b2", "a9", "a10", "", None]
    for k, name in enumerate(order):
        text, other = texts[name], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        own, changed, following = map(order_minhash.signature, (text, edited, other))
        assert got[name]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[name]["near_edited"] == float((own == changed).mean())
        assert got[name]["near_next"] == float((own == following).mean())
    whole = spark.createDataFrame([(5, "five is a number"), (None, "none"), (40, "forty")], "doc_id int, text string")
    assert {r["doc_id"]: r["edited_sha256"] for r in order_minhash.half_edited(whole).collect()}[40] == hashlib.sha256(b"forfi").hexdigest()


def test_batches_are_cut_by_bytes(spark):
    """A worker gets long texts a few at a time, whatever the number of rows in a batch."""
    common.prepare(spark)
    texts = spark.range(0, 60, 1, 1).select(F.expr("repeat('word ', 200000)").alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert max(r["n"] for r in sizes.collect()) <= common.BATCH_BYTES + 1_100_000


def test_decontamination(spark, nothing):
    items = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (8, "Short One"),
                                   (9, None), (None, ""), (8, "other tail")], "item_id long, text string")
    rows = [(1, "say ALPHA, beta gamma delta epsilon zeta eta theta iota kappa! end of a long enough text to stay in the corpus", None),
            (2, "beta gamma delta epsilon zeta eta theta iota kappa", None), (3, "a short one", None), (4, None, None),
            (5, "", None), (1, "clean", None), (None, "short-one", None)]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.report(docs, items).collect()}
    digest = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    brief = {k: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for k, r in got.items()}
    assert brief == {(1, 22): (10, 1, digest("7"), True), (2, 9): (0, 0, digest(), False), (3, 3): (2, 1, digest("8"), True),
                     (4, 0): (0, 0, digest(), False), (5, 0): (0, 0, digest(), False), (1, 1): (0, 0, digest(), False),
                     (None, 2): (2, 1, digest("8"), True)}
    # In several passes the same comes out.
    small = decontaminate.find(docs, items, block_words=12).select("doc_id", "_leak.n_words", "_leak.n_hit", "_leak.items")
    assert {(r[0], r[1]): (r[2], len(r[3])) for r in small.collect()} == {k: v[:2] for k, v in brief.items()}
    kept = decontaminate.clean(docs, items, length_col="n_chars")
    assert kept.columns == docs.columns
    texts = {(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()}
    rest = "say \n! end of a long enough text to stay in the corpus"
    assert texts == {(1, rest, len(rest)), (2, rows[1][1], len(rows[1][1])), (4, None, 0), (5, "", 0), (1, "clean", 5)}
    assert decontaminate.report(nothing, items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).filter("contaminated").count() == 0


def brute_classes(rows, width=5):
    sets = []
    for _, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return Counter(out)


def test_unsettled_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long")
    with pytest.raises(RuntimeError):
        components.connected_components(Scratch(spark, "test-chain"), chain, "short", most_rounds=2)
    got = components.connected_components(Scratch(spark, "test-chain"), chain, "whole").collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(51)}


def test_few_sets_of_a_component_are_compared_first(spark):
    scratch = common.Scratch(spark, "test")
    members = [(7, s, 100, 100, s) for s in range(1, 44)]  # one list: 40 sets of a component, 3 apart
    lists = spark.createDataFrame(members, "key long, sid long, n int, most int, rare int")
    labels = spark.createDataFrame([(s, 1) for s in range(1, 41)], "node long, component long")
    pairs = lambda few: {tuple(r) for r in jaccard_join._crossing(scratch, lists, labels, 80, "t", few).collect()}
    assert pairs(None) == {(u, v) for u in range(1, 44) for v in range(41, 44) if u < v}
    assert pairs(4) == {(u, v) for u in [1, 2, 3, 4, 41, 42] for v in range(41, 44) if u < v}


def test_merged_components(spark):
    scratch = common.Scratch(spark, "test")
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(6, 9), (3, 9), (20, 21)], "u long, v long")
    got = {(r["node"], r["component"]) for r in jaccard_join._merged(scratch, labels, links, "t").collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (5, 3), (6, 3), (8, 3), (9, 3), (20, 20), (21, 20)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, nothing, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_PART", 4)  # divides lists of frequent keys
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [chance.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(60):
        words = [chance.choice(vocabulary) for _ in range(chance.choice([1, 3, 5, 8, 9, 14, 30, 60, 90]))]
        if i % 3 == 0:
            words[2:2] = passage
        rows.append((i, " ".join(words), None))
        for _ in range(chance.randrange(0, 7)):
            copy = list(words)
            for _ in range(chance.randrange(0, 3)):
                copy[chance.randrange(len(copy))] = chance.choice(vocabulary)
            if chance.random() < 0.5:
                copy.insert(chance.randrange(len(copy) + 1), chance.choice(vocabulary))
            rows.append((1000 - len(rows), " ".join(copy).upper(), None))
    rows += [(2000, None, None), (2001, "", None), (2002, " ", None), (None, rows[0][1], None), (2003, "one", None), (2004, "One", None),
             (0, rows[0][1], None), (2005, "long text " * 5000, None)]
    got = jaccard_join.similar(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows)
    assert jaccard_join.similar(nothing).count() == 0


def test_language_model(spark, docs, nothing):
    scratch = Scratch(spark, "test-lm")
    held_out = fold(F.col("doc_id")) == 1
    model = language_model.fit(docs, ~held_out, scratch)
    got = language_model.score(docs, model, scratch, held_out).toPandas()
    rows = corpus()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for _, t, _ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
                  for ws in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert set(got["train_tokens"]) == {n} and (got["score"] < 0).all() and (got["bits_per_byte"] > 0).all()
    empty = language_model.fit(nothing, ~held_out, Scratch(spark, "test-lm"))
    assert language_model.score(nothing, empty, Scratch(spark, "test-lm"), held_out).count() == 0


def test_language_model_learns_from_texts_of_any_number_and_length(spark):
    """Code, weights and map are those of all training texts at once, whatever they are divided into."""
    from retentio.llm import mixing
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(900)]  # 2.2 MB and one text of 1.2 MB: more than was sampled
    texts.append(" ".join(rng.choice(words, 200_000)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = language_model.fit(docs, F.lit(True), Scratch(spark, "test-lm"))
    raw, offsets = common.text_buffer(pa.array(texts))
    code = mixing.build_code(*mixing.symbol_counts(raw, offsets))
    assert np.array_equal(code.path, model.code.path) and np.array_equal(code.which, model.code.which)
    tables = [np.zeros(2 << b, np.uint32) for b in mixing.SLOT_BITS]
    mixing.count(code, raw, offsets, tables)
    mixer = mixing.fit_mixer(code, tables, raw, offsets)
    assert np.allclose(mixer.weights, model.mixer.weights, atol=1e-6) and np.allclose(mixer.refined, model.mixer.refined, atol=1e-6)
    assert all(np.array_equal(a, b) for a, b in zip(mixing.stretched(tables), model.maps))
