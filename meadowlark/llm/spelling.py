"""Spelling variants: words one edit apart, found in tries of letter-group counts that are spread over tasks.

A word's vector counts its letters by group. One inserted, deleted or replaced letter adds at most one to one count (the
surplus) and takes at most one from another (the deficit), so a trie of successive counts is searched depth first with a
budget of one each; the words at the leaves reached are verified letter by letter. The first counts are the key of a part
of the trie: words go to their part, and each word is asked in every part that its budget reaches. A part with many
words is dealt over several tries, and all of them are asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Letters of a run; only A-Z are lower-cased.
RUN_PATTERN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by crc32 of id and run, loses a letter.
DAMAGED = 199
#: Words have at least so many letters and occurrences.
LENGTH, OCCURRENCES = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5

# Letter groups, in the trie's order: the first PREFIX ones are the key of a part.
GROUPS = ("e", "a", "n", "ir", "to", "s", "hd", "lu", "cm", "gbf", "pwvy", "kjxqz")
PREFIX = 3
#: A group of its own for every other letter.
N_GROUPS = len(GROUPS) + 1
_GROUP_OF = {c: i for i, g in enumerate(GROUPS) for c in g}
#: Words of a trie, and of an unbranched leaf.
TRIE_WORDS, LEAF_WORDS = 20_000, 8


def damaged_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): the lower-cased runs of all whole texts, one in 199 short of a letter. A null id counts as the empty text."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN_PATTERN), F.lit(0))).alias("_run"))
    # Runs repeat inside a text, and their hash depends on id and run only.
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    return runs.withColumn("_h", h).select(F.when(F.col("_h") % DAMAGED == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(runs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return runs.where(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def letter_counts(word: str) -> tuple[int, ...]:
    counts = [0] * N_GROUPS
    for c in word:
        counts[_GROUP_OF.get(c, N_GROUPS - 1)] += 1
    return tuple(counts)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class Trie:
    """Words by successive letter-group counts. A node is a list of (counts, word, n), or a dict of nodes by the next count."""

    def __init__(self) -> None:
        self.root: list | dict = []

    def add(self, word: str, n: int) -> None:
        counts, node, above, level = letter_counts(word), self.root, None, 0
        while isinstance(node, dict):
            above, node = node, node.setdefault(counts[level], [])
            level += 1
        node.append((counts, word, n))
        if len(node) > LEAF_WORDS and level < N_GROUPS:
            branches: dict = {}
            for leaf in node:
                branches.setdefault(leaf[0][level], []).append(leaf)
            if above is None:
                self.root = branches
            else:
                above[counts[level - 1]] = branches

    def near(self, word: str) -> list[tuple[str, int]]:
        """(word, n) of the words one edit away."""
        # One edit leaves the first or the second half of the shorter word as it is.
        half = (len(word) - 1) // 2
        counts, head, tail, found = letter_counts(word), word[:half], word[len(word) - half :], []

        def visit(node: list | dict, level: int, surplus: int, deficit: int) -> None:
            if isinstance(node, list):
                found.extend([(other, n) for _, other, n in node if (other.startswith(head) or other.endswith(tail)) and one_edit(word, other)])
                return
            c = counts[level]
            if (same := node.get(c)) is not None:
                visit(same, level + 1, surplus, deficit)
            if surplus and (more := node.get(c + 1)) is not None:
                visit(more, level + 1, 0, deficit)
            if deficit and (less := node.get(c - 1)) is not None:
                visit(less, level + 1, surplus, 0)

        visit(self.root, 0, 1, 1)
        return found


def _prefix(word: Column) -> list[Column]:
    """The counts of the first groups."""
    return [F.char_length(word) - F.char_length(F.translate(word, g, "")) for g in GROUPS[:PREFIX]]


def _key(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def _reached(counts: list[Column]) -> Column:
    """The keys of all parts that a word's budget reaches, its own among them."""
    moves = [()] + [((i, 1),) for i in range(PREFIX)] + [((i, -1),) for i in range(PREFIX)] + [((i, 1), (j, -1)) for i in range(PREFIX) for j in range(PREFIX) if i != j]
    return F.array(*(_key([c + dict(m).get(i, 0) for i, c in enumerate(counts)]) for m in moves))


_ANSWERS = "word string, near long, form string, form_n long"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: of each trie its words, then the words asked in it. Answers are sums of a word in one trie."""
    trie, at = Trie(), None
    for batch in batches:
        words, near, forms, form_ns = [], [], [], []
        for key, deal, asked, word, n in zip(*(batch[c].to_pylist() for c in ("key", "deal", "asked", "word", "n")), strict=True):
            if at != (key, deal):
                trie, at = Trie(), (key, deal)
            if not asked:
                trie.add(word, n)
            elif found := trie.near(word):
                best = max(x for _, x in found)
                words.append(word)
                near.append(len(found))
                forms.append(min(w for w, x in found if x == best))
                form_ns.append(best)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(forms, pa.string()), pa.array(form_ns, pa.int64())], ["word", "near", "form", "form_n"])


def near_words(words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a near one; ties to the smallest in code points.

    Words must be distinct. No task holds more than ``trie_words`` words at once (about; they are dealt by hash).
    """
    counts = _prefix(F.col("word"))
    parts = words.withColumn("key", _key(counts))
    sizes = parts.groupBy("key").agg(F.ceil(F.count("*") / trie_words).cast("int").alias("deals"))
    held = parts.join(sizes, "key").select("key", F.pmod(F.xxhash64("word"), "deals").cast("int").alias("deal"), F.lit(False).alias("asked"), "word", "n")
    asked = words.select(F.explode(_reached(counts)).alias("key"), "word", "n").join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(True).alias("asked"), "word", "n")
    dealt = held.unionByName(asked).repartition("key", "deal").sortWithinPartitions("key", "deal", "asked")
    answers = dealt.mapInArrow(_asked, _ANSWERS)
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    return answers.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_best")).select("word", "n_near", F.col("_best.form").alias("best"), F.col("_best.form_n").alias("best_n"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words of (word, form): forms of forms, doubled until the longest chain ends.

    Every form is TIMES as frequent as its variant, so a chain from OCCURRENCES to ``most`` has a bounded length.
    """
    steps = max(1, math.ceil(math.log(max(most, 1), TIMES)))
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)) + 1)):
        further = roots.select(F.col("word").alias("_w"), F.col("root").alias("_further"))
        roots = stored(roots.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_further", "root").alias("root")))
    return roots


def variants(words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n), words being distinct."""
    words = stored(words)
    near = near_words(words, trie_words)
    is_form = F.col("best_n") >= F.col("n") * TIMES
    formed = stored(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    most = formed.agg(F.max("n")).first()[0] or 1
    roots = _roots(formed.where("form is not null").select("word", "form"), most)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
