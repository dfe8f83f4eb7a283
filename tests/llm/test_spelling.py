"""Spelling variants against all pairs of words, and awkward rows."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meadowlark.llm import queries as llm_queries
from meadowlark.llm import spelling

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def words_by_hand(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits_by_hand(words):
    """Pairs of words one edit apart: equal after a letter is taken out, at one place of both or of one."""
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
            holes[w[:i], w[i + 1 :]].add(w)
    for same in holes.values():
        for a, b in itertools.permutations(same, 2):
            near[a].add(b)
    return near


def variants_by_hand(counts):
    near, forms = edits_by_hand(set(counts)), {}
    for w in counts:
        if best := min(near[w], key=lambda x: (-counts[x], x), default=None):
            forms[w] = best if counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while forms.get(root):
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, n, len(near[w]), counts[form] if form else None))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_variants_of_documents_are_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows_of(llm_queries.queries()["op11_spelling_variants"](spark, FOLDER)) == variants_by_hand(words_by_hand([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("trie_words", [1, 40, 20_000])
def test_variants_of_crowded_words(spark, trie_words):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.choice([6, 7]))) for _ in range(300)} | {"".join(rng.choices("eeantz", k=8)) for _ in range(300)}
    counts = {w: rng.choice([5, 5, 24, 25, 125, 625, 3125]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df, trie_words)) == variants_by_hand(counts)


def test_roots_follow_the_longest_chain(spark):
    chain = ["abcdef" + "x" * i for i in range(9)]
    counts = {w: 5 ** (i + 1) for i, w in enumerate(chain)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1]}


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "bc", True), ("abc", "axc", True), ("abc", "bac", False), ("", "a", True), ("ab", "abcd", False), ("aab", "ab", True)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) is near and spelling.one_edit(b, a) is near


def test_trie_keeps_words_of_equal_counts():
    trie = spelling.Trie()
    words = ["".join(p) for p in itertools.permutations("abcdef")]
    for w in words:
        trie.add(w, 1)
    assert len(trie.near("abcdefg")) == sum(spelling.one_edit("abcdefg", w) for w in words) == 1
    assert len(trie.near("abcdex")) == 1


def test_variants_of_awkward_rows(spark):
    rows = [(1, "Wonder wonder WONDER wonder wonder " * 9), (1, "Wonder wonder WONDER wonder wonder " * 9), (None, "wonders " * 9), (None, None), (2, ""), (3, "ÀÉÎÕÜß àéîõüÿ×÷ " * 5), (4, "x" * 100_000), (5, "wond3r " * 9)]
    clash = {c: F.lit(1) for c in ("word", "n", "key", "deal", "form", "root", "near", "_id", "_run", "_h")}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(clash)
    got = rows_of(spelling.variants(spelling.vocabulary(spelling.damaged_runs(docs))))
    assert got == variants_by_hand(words_by_hand(rows)) and ("wonders", "wonder", "wonder", 9, 1, 90) in got


def test_variants_of_an_empty_table(spark):
    assert rows_of(spelling.variants(spelling.vocabulary(spelling.damaged_runs(spark.createDataFrame([], SCHEMA))))) == []
