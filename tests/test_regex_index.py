"""Regex search through trigram postings: required runs, candidates and results against brute force."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from retentio.operators import hot_join, regex_index as RI
from retentio.operators.clean import lookup_customer


@pytest.mark.parametrize("pattern,runs", [
    ("abc", ["abc"]), ("^CUST-0.*7$", ["cust-0", "7"]), ("ab+c", ["ab", "c"]), ("ab?c", ["a", "c"]), ("ab{0,2}cde", ["a", "cde"]),
    ("ab{2}cd", ["ab", "cd"]), (r"a\.b\d+c", ["a.b", "c"]), ("(abc)+d", ["abc", "d"]), ("(?:abc)?def", ["def"]), ("abc|abd", []),
    ("x(abc|abd)yz", ["x", "yz"]), ("[abc]def[^]]", []), ("[a-c[xy]]def", ["def"]), ("ab(cd(ef)gh)ij", ["ab", "cd", "ef", "gh", "ij"]),
    ("(?i)abc", ["abc"]), ("(?=abc)x", []), (r"\Qa.b\E", []), (r"\p{L}abc", []), ("abé9", ["ab", "9"]), ("abc)", []), ("(abc", []),
    ("abc*?def", ["ab", "def"]), (r"abc\b-d", ["abc", "-d"]), ("", []), ("a{2,}bcd", ["a", "bcd"]), ("ab**", [])])
def test_required_runs(pattern, runs):
    assert RI.required_runs(pattern) == runs


ATOMS = st.sampled_from(["a", "b", "0", "1", "-", ".", "[ab]", "[^0]", "(ab)", "(a|b)", "(?:0-1)", r"\\d", r"\\-", "^", "$", "ab0", "10-"])
PARTS = st.tuples(ATOMS, st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{0,1}", "*?", "{1,}"])).filter(
    lambda t: not (t[0] in "^$" and t[1])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=6).map("".join), st.text("ab01-", max_size=12))
def test_every_match_holds_the_runs(pattern, text):
    if re.search(pattern, text, re.I):
        assert all(run in text.lower() for run in RI.required_runs(pattern))


IDS = [f"CUST-{i:05d}" for i in range(400)] + [f"x{i}-Ab{i % 7}" for i in range(60)] + ["é-CUST", "ab", ""]
PATTERNS = ["0042$", "^cust-.0[12]3", "cust", "ab[36]$", "(cust|x1)-0+7$", "x.-ab", "[0-9]{5}", "nothing.here", "é-c.st", "^$", "cust-00(1|2)99", "^ab$",
            r"cust\-00111", "xab+", "0*399"]


@pytest.mark.parametrize("least,block", [(100, 256), (2, 1)])
def test_search(spark, monkeypatch, least, block):
    # Small shares make common trigrams heavy, small blocks split the patterns that share one.
    monkeypatch.setattr(hot_join, "LEAST_ROWS", least)
    monkeypatch.setattr(RI, "PATTERN_BLOCK", block)
    subs = spark.createDataFrame([(i,) for i in IDS], "customerID string")
    qs = spark.createDataFrame([(q,) for q in PATTERNS], "query string")
    got = {r["query"]: (r["customerID"], r["match_type"]) for r in lookup_customer(subs, qs).collect()}
    want = {}
    for q in PATTERNS:
        literal = not re.search(r"[\\^$.|?*+()\[\]{}]", q)
        hits = [i for i in IDS if (q in i.lower() if literal else re.search(q, i, re.I))]
        if hits:
            want[q] = (min(hits), "contains")
    assert got == want


def test_no_id_meets_a_pattern_without_a_shared_trigram(spark):
    ids = spark.createDataFrame([(i, i.lower()) for i in IDS], "_id string, _lid string")
    pats = RI.with_trigrams(spark.createDataFrame([(q,) for q in PATTERNS], "query string")).withColumn(
        "_pat", F.concat(F.lit("(?i)"), "query")).filter(F.size("_tris") > 0)
    met = RI.candidates(ids, pats).collect()
    assert met and all(set(RI.trigrams(r["query"])) <= {r["_id"].lower()[k:k + 3] for k in range(len(r["_id"]) - 2)} for r in met)
    assert len([r for r in met if r["query"] == "0042$"]) == 1
    assert {r["query"] for r in pats.select("query").collect()} == {q for q in PATTERNS if RI.trigrams(q)}
