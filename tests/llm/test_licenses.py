"""License scans against plain loops over words, their SQL, and awkward rows."""

import re

import pytest
from pyspark.sql import functions as F

from meadowlark.llm import licenses
from meadowlark.llm import queries as llm_queries

from ..compare import duck, same

SCHEMA = "doc_id long, text string"
MIT = dict((label, text) for text, label in licenses.NOTICES)["mit"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def phrases_by_hand(text):
    w = words(text)
    return [(p, p + len(x) - 1, label) for p in range(len(w)) for phrase, label in licenses.PHRASES if w[p : p + len(x := phrase.split())] == x]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_scan_equals_sql(spark, folder):
    same(llm_queries.queries()["op12_license_scan"](spark, folder), duck(folder), llm_queries.oracle_sql()["op12_license_scan"])


TEXTS = [
    None, "", "  ", "MIT License", "mit", "license mit license", "MIT licenses", "the GNU General Public License, Apache license; apache-license CC BY-SA cc\nby", "cc by cc by cc by",
    "GNU General Public", "GNU GNU General Public License License", "K mit license İ", "é\x00mit\x00license\x7fé", MIT.upper(), "mit " * 5000 + "license", "ccé by cc by",
]


def test_phrases_are_found_word_by_word(spark):
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].n_words == len(words(text))
        assert sorted((s.first, s.last, s.label) for s in got[i].spans if s.exact) == sorted(phrases_by_hand(text))


@pytest.mark.parametrize(("text", "found"), [
    (MIT, 1.0), (f"so {MIT} and so on", 1.0), (MIT.replace("free of charge", "without charge"), 0.7), (MIT.replace("granted", "granted hereby again"), 0.7), (MIT.replace("software and", "software or its"), 0.7),
    (" ".join(MIT.split()[:9]), None), (MIT.replace(" ", " x "), None), (" ".join(MIT.split()[:10]) + " y" * 200 + " " + " ".join(MIT.split()[10:]), None)])
def test_notices_are_merged_diagonals(spark, text, found):
    spans = [s for s in licenses.scan(spark.createDataFrame([(1, text)], SCHEMA)).first().spans if not s.exact]
    assert [s.label for s in spans] == (["mit"] if found else [])
    assert not found or spans[0].score >= found and spans[0].first == text.split().index("permission")


def test_two_notices_of_a_text_are_two_spans(spark):
    r = licenses.scan(spark.createDataFrame([(1, f"{MIT} so {MIT}")], SCHEMA)).first()
    n = len(MIT.split())
    assert [(s.first, s.last, s.score) for s in r.spans] == [(0, n - 1, 1.0), (n + 1, 2 * n, 1.0)]


def test_scan_of_awkward_rows(spark):
    rows = [(1, "mit license"), (1, "mit license"), (1, "apache license"), (None, "mit license"), (None, None), (2, "word " * 200_000 + "cc by")]
    clash = {c: F.lit(1) for c in ("_words", "_p", "template", "label", "k", "q", "spans", "n_words", "_hash", "span", "length", "exact")}
    got = sorted(((r.doc_id, r.n_words, [(s.first, s.label) for s in r.spans]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).withColumns(clash)).collect()), key=repr)
    assert got == sorted([(1, 2, [(0, "mit")])] * 2 + [(1, 2, [(0, "apache")]), (None, 2, [(0, "mit")]), (None, 0, []), (2, 200_002, [(200_000, "cc-by")])], key=repr)


def test_scan_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scan_has_no_python(spark):
    plan = llm_queries.queries()["op12_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|Cartesian|NestedLoop", plan)
