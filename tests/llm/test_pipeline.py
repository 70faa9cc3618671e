"""The pipeline's stages on planted cases, each against brute force on its own input."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from retentio.llm import decontaminate, packing
from retentio.llm.common import plain_words, prepare

from .test_operators import brute_classes

KINDS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                   ("n_chars", pa.int64()), ("score", pa.float64()), ("class", pa.string())])


def write(folder, rows, labels, items):
    pq.write_table(pa.Table.from_pylist([dict(zip(KINDS.names, (i, t, "en", "s", len(t or ""), 0.1, "c"))) for i, t in rows],
                                        KINDS), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()),
                             "toxic": pa.array([x for _, x in labels], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}),
                   f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    chance = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "cloud", "grass", "field") for b in ("", "s", "ing", "ed", "ly")]
    items = [" ".join(chance.choice(vocabulary) + str(k) for k in range(14)) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        words = [chance.choice(vocabulary) for _ in range(chance.randrange(20, 60))]
        if i % 6 == 0:
            words[4:4] = ["nastyword", "vileword", "foulword"]
        elif i % 6 == 1:
            words[9:9] = items[i % 4].split()
        elif i % 6 == 2:
            words[3:3] = ["token", "=", '"' + "".join(chance.choice("0123456789abcdef") for _ in range(40)) + '"']
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
        if i % 6 == 4:
            rows += [(1000 + i, " ".join(words)), (2000 + i, " ".join([*words, "end"]))]
    rows += [(rows[5][0], rows[5][1]), (3000, None), (3001, ""), (None, "a row without an id"), (3002, items[0])]
    folder = tmp_path_factory.mktemp("planted")
    write(folder, rows, labels, items)
    return str(folder), items


def pairs(df):
    return [(r["doc_id"], r["text"], None) for r in df.collect()]


def test_stages(spark, planted, tmp_path):
    folder, items = planted
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name] = docs, spark.read.parquet(f"{tmp_path}/{k}")
        docs = seen[name][1]
    before, after = (pairs(x) for x in seen["toxicity"])
    assert Counter(after) == Counter(r for r in before if "vileword" not in (r[1] or ""))
    before, after = (pairs(x) for x in seen["near_duplicates"])
    keep = {c for _, _, c in brute_classes(before)}
    assert Counter(i for i, _, _ in after) == Counter(keep)
    before, after = ({i: t for i, t, _ in pairs(x)} for x in seen["decontamination"])
    automaton = decontaminate.SuffixAutomaton([(str(k), plain_words(t)) for k, t in enumerate(items)], 10)
    assert not any(automaton.scan(plain_words(t))[0] for t in after.values())
    assert before.keys() - after.keys() == {3002}
    assert all(after[i] == t for i, t in before.items() if i != 3002 and not automaton.scan(plain_words(t))[0])
    before, after = ({i: t for i, t, _ in pairs(x)} for x in seen["secrets"])
    assert before.keys() == after.keys()
    assert all((after[i] == t) == ("token" not in (t or "")) for i, t in before.items())
    assert seen["secrets"][1].filter("n_chars != coalesce(length(text), 0)").count() == 0
    encoder = packing.WordEncoder(packing.tokenizer_path())
    sizes = Counter()
    for r in seen["packing"][1].collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {i: len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after.items()}


def test_empty_tables(spark, tmp_path):
    write(tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert np.all([len(s) == 2 for s in corpus_pipeline.STAGES])
