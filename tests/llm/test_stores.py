"""Conversation trie, WARC store and Merkle manifest against brute force, with nulls, ties, repeated rows and hot keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from retentio.llm import conversation_trie, merkle, queries, warc_store
from retentio.llm.common import Scratch, prepare
from retentio.operators import hot_join


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Conversation trie

TURNS = "conv_id long, turn long, role string, text string, depth int, conv string, f1 int, part int, pos string"


def turn_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, "c", 2, 3, "p") for r in rows], TURNS).repartition(5)


def base(c):
    return c - F.expr("conv % 100")


def head(c):
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 6


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        if c is None:
            rebuilt[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    order = lambda c: (c is None, c or 0)
    least = {p: min(m, key=order) for p, m in members.items()}
    out = []
    for p, m in members.items():
        inside = [q for q in members if q[:len(p)] == p]
        children = [q for q in inside if len(q) == len(p) + 1]
        childless = [q for q in inside if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in inside)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q)
        ends = sorted((c for c in m if len(rebuilt[c]) == len(p)), key=order)
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(m), len(children), len(childless), saved,
                    sha(",".join("" if c is None else str(c) for c in ends))))
    return Counter(out)


def trie_rows():
    chance = random.Random(3)
    rows = []
    for c in [*range(0, 30), *range(100, 130), 305, 306, 411, -7, -107, 7000]:
        length = chance.randrange(1, 8)
        for t in range(length):
            rows.append((c, t, chance.choice(["user", "assistant"]), f"say {t} {chance.randrange(2)} é"))
    # Copies of whole conversations, repeated rows, equal and null turns, null ids, roles and texts.
    rows += [(c, t, "user", f"same {t}") for c in range(500, 520) for t in range(6)]
    rows += [rows[3]] * 3 + [(12, None, None, None), (12, None, "user", ""), (13, 2, "user", "tie"), (13, 2, "user", "other")]
    rows += [(None, 0, "user", "say 0 0 é"), (None, 1, None, "x" * 50_000), (600, 0, "user", "y" * 100_000)]
    return rows


def trie_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_trie(spark):
    rows = trie_rows()
    got = conversation_trie.trie(turn_frame(spark, rows), Scratch(spark, "t"), base, head)
    assert trie_counter(got) == brute_trie(rows)
    assert dict(got.dtypes)["saved_tokens"] == "bigint"
    assert conversation_trie.trie(turn_frame(spark, []), Scratch(spark, "t"), base, head).count() == 0


def test_trie_long_conversation_over_many_tasks(spark):
    # One conversation holds most rows, so its products are combined over all tasks.
    rows = [(1, t, "user", f"t{t % 7}") for t in range(300)] + [(2, t, "user", f"t{t % 7}") for t in range(298)]
    rows += [(c, 0, "user", "t0") for c in range(3, 40)]
    scratch = Scratch(spark, "t")
    got = conversation_trie.trie(turn_frame(spark, rows), scratch, lambda c: F.lit(None).cast("long"), lambda c: F.lit(0))
    by_depth = {r["depth"]: r for r in got.collect()}
    assert len(by_depth) == 301
    assert (by_depth[1]["n_convs"], by_depth[2]["n_convs"], by_depth[299]["n_convs"]) == (39, 2, 1)
    assert by_depth[0]["saved_tokens"] == 38 * 2 + 297 * 2 and by_depth[0]["n_leaves"] == 1
    assert by_depth[298]["ends_sha256"] == sha("2") and by_depth[1]["ends_sha256"] == sha(",".join(map(str, range(3, 40))))


def test_trie_false_matches_begin_anew(spark):
    rows = trie_rows()
    with pytest.raises(RuntimeError, match="share a fingerprint"):
        conversation_trie.trie(turn_frame(spark, rows), Scratch(spark, "t"), base, head, prime=2, seeds=2)
    scratch = Scratch(spark, "t")
    got = conversation_trie.trie(turn_frame(spark, rows), scratch, base, head, prime=13, seeds=60)
    assert trie_counter(got) == brute_trie(rows)


def test_member_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    rows = [(c, 0, "user", "a") for c in range(50)]
    got = conversation_trie.trie(turn_frame(spark, rows), Scratch(spark, "t"), lambda c: F.lit(None).cast("long"), lambda c: F.lit(0))
    assert trie_counter(got) == Counter([(0, 0, None, 50, 1, 1, 49, sha("")), (0, 1, 0, 50, 0, 1, 49, sha(",".join(map(str, range(50)))))])


# WARC store

def page_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 1, "h") for r in rows],
                                 "page_id long, url string, html string, digest string, record int, header string").repartition(4)


def page_rows():
    big, long_text = "<p>é\r\n\r\nWARC/1.1\r\n" + "a" * 200, "z" * 3_000_000
    rows = [(i, f"http://a/{i}", big) for i in (9, 4, 7, 7)] + [(i, f"http://b/{i}", "short") for i in range(3)]
    rows += [(20, None, None), (21, "http://c/ d\r\nX: y", ""), (None, "http://d", big), (None, None, long_text), (30, "http://e", long_text),
             (4, "http://a/4", big), (31, "u", "é" * 50), (32, "u", "é" * 50), (33, "u", "e" * 99), (34, "u", "e" * 99)]
    return rows + [(1000 + i, "http://hot", "hot " * 40) for i in range(400)]


def brute_warc(rows):
    out, groups = [], defaultdict(list)
    for i, u, h in rows:
        groups[h or ""].append(i)
    for h, ids in groups.items():
        data = h.encode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = len(data) >= 100 and k > 0
            out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return Counter(out)


def test_warc(spark, tmp_path):
    rows = page_rows()
    scratch = Scratch(spark, "w")
    archive = warc_store.write(page_frame(spark, rows), scratch)
    assert Counter(tuple(r) for r in warc_store.report(archive).collect()) == brute_warc(rows)
    assert archive.payloads.count() == len({h or "" for _, _, h in rows})
    # Opened anew, and its records written as files that any WARC reader can split by Content-Length.
    again = warc_store.Archive.open(spark, scratch.root)
    warc_store.export(again, f"{tmp_path}/out")
    found = []
    for path in sorted((tmp_path / "out").glob("part-*")):
        data = path.read_bytes()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            block, data = rest[:n], rest[n:]
            assert head.startswith(b"WARC/1.1\r\n") and data.startswith(b"\r\n\r\n")
            data = data[4:]
            http, payload = block.split(b"\r\n\r\n", 1)
            assert int(re.search(rb"Content-Length: (\d+)", http).group(1)) == len(payload) or fields[b"WARC-Type"] == b"revisit"
            if fields[b"WARC-Type"] == b"response":
                assert b"sha256:" + hashlib.sha256(payload).hexdigest().encode() == fields[b"WARC-Payload-Digest"]
            found.append((fields[b"WARC-Type"].decode(), payload.decode()))
    assert Counter(found) == Counter((t, h if t == "response" else "")
                                     for (_, _, d, t, _), n in brute_warc(rows).items() for _ in range(n)
                                     for h in [next(x or "" for _, _, x in rows if sha(x or "") == d)])
    urls = Counter((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in warc_store.records(again).collect())
    assert urls == Counter((i, u, h or "") for i, u, h in rows)
    assert warc_store.report(warc_store.write(page_frame(spark, []), Scratch(spark, "w"))).count() == 0


def test_warc_finds_damage(spark):
    archive = warc_store.write(page_frame(spark, page_rows()[:5]), Scratch(spark, "w"))
    bad = warc_store.Archive(archive.headers, archive.payloads.withColumn("payload", F.lit(b"other")), archive.kind)
    with pytest.raises(PySparkException, match="does not match its digest"):
        warc_store.report(bad).collect()
    gone = warc_store.Archive(archive.headers, archive.payloads.limit(0), archive.kind)
    with pytest.raises(PySparkException, match="no payload is stored"):
        warc_store.report(gone).collect()


# Merkle manifest

def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_paths(hashes):
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, p in enumerate(at):
            run = p - p % 3
            paths[k].append((hashes[run:p], hashes[p + 1:run + 3]))
            at[k] = p // 3
        hashes = [sha(*hashes[i:i + 3]) for i in range(0, len(hashes), 3)]
    return hashes[0], paths


def brute_merkle(rows):
    """(id, leaf, subroot, root, proof, folded, verified) of rows (id, source, lang, n, text)."""
    made = sorted(((s is not None, (s or "").encode(), i is not None, i or 0, sha(*map(enc, (i, s, lang, n, t)))), (i, s, lang, n, t))
                  for i, s, lang, n, t in rows)
    groups = []
    for key, row in made:
        if not groups or groups[-1][0] != key[:2]:
            groups.append((key[:2], []))
        groups[-1][1].append((key[4], row))
    inner = [brute_paths([leaf for leaf, _ in g]) for _, g in groups]
    root, upper = brute_paths([sub for sub, _ in inner])
    out = []
    for (_, g), (sub, paths), tail in zip(groups, inner, upper):
        for (leaf, (i, s, lang, n, t)), path in zip(g, paths):
            steps = path + tail
            even = zlib.crc32(("" if i is None else str(i)).encode()) % 2 == 0
            acc = sha(*map(enc, (i, s, lang, n, t.replace("\n", "") if even and t is not None else t)))
            for left, right in steps:
                acc = sha(*left, acc, *right)
            out.append((i, leaf, sub, root, sha(*[x for left, right in steps for x in left + right]), acc, acc == root))
    return Counter(out)


def doc_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 1, "g") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, "
                                 "leaf string, tree int, group string").repartition(4)


def merkle_counter(spark, rows):
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    claims = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    made = merkle.build(doc_frame(spark, rows), Scratch(spark, "m"), claims=claims)
    return Counter(tuple(r) for r in merkle.verify(made).collect())


def test_merkle(spark):
    chance = random.Random(5)
    rows = [(i, "hot", "en", i % 7, f"a{i}\nb") for i in range(250)]
    rows += [(chance.randrange(1000), f"s{chance.randrange(9)}", None, None, chance.choice(["x", "x\n", "", None, "é\n\n"])) for _ in range(90)]
    rows += [(5, "Ä", "de", 1, "one"), (6, "z", "de", 1, "long\n" * 200_000), (None, None, None, None, None), (7, None, "a", 2, "\n"),
             (None, "hot", "en", 0, "q\n")] + [(8, "z", "de", 1, "again\n")] * 4
    assert merkle_counter(spark, rows) == brute_merkle(rows)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4], [10, 1, 1, 1], [28], [82, 27, 9]])
def test_merkle_shapes(spark, sizes):
    rows = [(100 * k + i, f"s{k}", "en", 1, f"t{i}\n") for k, n in enumerate(sizes) for i in range(n)]
    assert merkle_counter(spark, rows) == brute_merkle(rows)


def test_merkle_empty(spark):
    made = merkle.build(doc_frame(spark, []), Scratch(spark, "m"))
    assert made.root is None and merkle.verify(made).count() == 0


# Joins with heavy keys

def test_join_hot(spark):
    rows = [(k % 3 if k < 900 else k, None if k % 5 == 0 else "a", k) for k in range(1200)]
    left = spark.createDataFrame(rows, "a long, b string, n long").cache()
    table = spark.createDataFrame([(a, b, f"{a}{b}") for a in range(1100) for b in ("a", None)], "a long, b string, v string")
    for most in (hot_join.MOST_HEAVY, 5):
        got = hot_join.join_hot(left, table, ["a", "b"], F.col("n"), most_heavy=most)
        assert got.columns == ["a", "b", "n", "v"]
        assert Counter(tuple(r) for r in got.collect()) == Counter((a, b, n, f"{a}{b}" if a < 1100 else None) for a, b, n in rows)
        assert hot_join.join_hot(left, table, ["a", "b"], F.col("n"), "inner", most).count() == sum(a < 1100 for a, _, _ in rows)


def test_registered_queries(spark):
    folder = "/root/testdata/sf0.001"
    trie = queries.QUERIES["op11_conversation_trie"](spark, folder)
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_counter(trie) == brute_trie(turns)
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.QUERIES["op12_warc_store"](spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in got.collect()) == brute_warc(pages)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.QUERIES["op13_merkle_manifest"](spark, folder).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r) for r in got.collect()) == brute_merkle(docs)
