"""DuckDB SQL for the conversation trie, the WARC store and the Merkle manifest."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a non-empty ASCII text, bit by bit."""
    step = "xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))"
    byte = f"list_reduce(list_prepend(xor(acc, b), range(8)::UBIGINT[]), lambda x, y: {step})"
    start = f"list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT))"
    return f"xor(list_reduce({start}, lambda acc, b: {byte}), 4294967295::UBIGINT)"


#: Rebuilt turns as lists, every prefix as text, sums over subtrees by every node's ancestors.
OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x FROM conversations),
own AS (SELECT c, list({{'x': x, 'chars': chars}} ORDER BY turn NULLS FIRST, x) AS seq FROM turns GROUP BY c),
asked AS (
  SELECT own.c, own.seq, CAST({crc32_sql("CAST(own.c AS VARCHAR)")} % 6 AS BIGINT) AS h, base.seq AS head
  FROM own LEFT JOIN own base ON base.c = own.c - own.c % 100),
rebuilt AS (SELECT c, list_concat(coalesce(head[1:h], []), seq[h + 1:]) AS seq FROM asked),
prefixes AS (
  SELECT c, d, len(seq) AS n, array_to_string(list_transform(seq[1:d], lambda t: t.x), ',') AS p,
    CASE WHEN d > 0 THEN array_to_string(list_transform(seq[1:d - 1], lambda t: t.x), ',') END AS up,
    CASE WHEN d > 0 THEN seq[d].chars ELSE 0 END AS chars
  FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, bool_and(d = n) AS leaf,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n) AS ends
  FROM prefixes GROUP BY d, p),
below AS (
  SELECT q.d, q.p, sum((u.n_convs - 1) * u.chars) AS saved, count(*) FILTER (WHERE u.leaf) AS leaves,
    count(*) FILTER (WHERE u.d = q.d + 1) AS children
  FROM nodes u JOIN prefixes q ON q.c = u.conv_id AND q.d <= u.d GROUP BY q.d, q.p)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, below.children AS n_children,
  below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN below ON below.d = nodes.d AND below.p = nodes.p
LEFT JOIN nodes parent ON parent.d = nodes.d - 1 AND parent.p = nodes.up
"""

OP12_SQL = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM rows WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, rows.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (digest)
"""


def _encoded(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _levels(name: str, levels: int) -> str:
    """CTEs of the trees over ``name``0 (tree, idx, h, n): one per level, and the runs of each."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_runs{k} AS (SELECT tree, idx // 3 AS run, list(h ORDER BY idx) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY 1, 2)""")
        out.append(f"""{name}{k + 1} AS (SELECT tree, CASE WHEN n > 1 THEN run ELSE 0 END AS idx,
  CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE 1 END AS n
FROM {name}_runs{k})""")
    return ",\n".join(out)


def op13_sql(levels: int = 12) -> str:
    """Level by level, for groups of at most 3 ** ``levels`` rows and as many groups."""
    own = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    even = f"{crc32_sql('CAST(doc_id AS VARCHAR)')} % 2::UBIGINT = 0"
    shown = own.replace(_encoded("text"), _encoded(f"(CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END)"))
    parts = [f"""leaves AS (SELECT doc_id, sha256({own}) AS leaf, sha256({shown}) AS claimed, source FROM documents)""",
             """placed AS (SELECT doc_id, leaf, claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves)""",
             "a0 AS (SELECT tree, idx, leaf AS h, n FROM placed)", _levels("a", levels),
             f"b0 AS (SELECT -1 AS tree, tree AS idx, h, count(*) OVER () AS n FROM a{levels})", _levels("b", levels),
             "f0 AS (SELECT doc_id, leaf, claimed, tree, idx, claimed AS acc, '' AS proof FROM placed)"]
    turn = 0
    for name in ("a", "b"):
        if name == "b":
            parts.append(f"f{turn + 1} AS (SELECT doc_id, leaf, claimed, tree, tree AS idx, acc, proof FROM f{turn})")
            turn += 1
        for k in range(levels):
            tree = "f.tree" if name == "a" else "-1"
            others = lambda a, b: f"array_to_string(hs[{a}:{b}], '')"
            left, right = others("1", "f.idx % 3"), others("f.idx % 3 + 2", "3")
            parts.append(f"""f{turn + 1} AS (SELECT doc_id, leaf, claimed, f.tree, f.idx // 3 AS idx,
  CASE WHEN r.n > 1 THEN sha256({left} || acc || {right}) ELSE acc END AS acc,
  CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof
FROM f{turn} f JOIN {name}_runs{k} r ON r.tree = {tree} AND r.run = f.idx // 3)""")
            turn += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT f.doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified
FROM f{turn} f JOIN a{levels} s USING (tree), b{levels} t
"""


ORACLES = {"op11_conversation_trie": OP11_SQL, "op12_warc_store": OP12_SQL, "op13_merkle_manifest": op13_sql()}
