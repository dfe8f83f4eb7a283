"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, forget, is_held_out, small_batches, worker_memo

#: Families of languages. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}
DIMENSION = 1 << 15
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, f"={language}")


class _Grams(dict):
    """Memo of a run of characters -> feature; emptied when full."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[gram] = at = xxhash.xxh3_64_intdigest(gram) & (DIMENSION - 1)
        return at


_grams = _Grams()


def plain(word: str) -> str:
    """A word in lower case without the punctuation around it."""
    return word.lower().strip("\"'`.,;:!?()[]{}<>|*_-/\\…“”‘’«»¿¡%#&$")


#: Longer words are not kept in memos but counted anew, in parts of so many characters.
LONG, PART = 40, 1 << 14


def word_parts(word: str) -> Iterator[np.ndarray]:
    """Indices of the word's runs of one to three characters, its ends marked, and of the word; each run in one part,
    that in which it starts."""
    marked = f" {word} "
    for start in range(0, len(marked), PART):
        part = marked[start : start + PART + 2]
        n = len(part)
        at = [_grams[c] for c in part[:PART]]
        at += [_grams[part[i : i + 2]] for i in range(min(PART, n - 1))]
        at += [_grams[part[i : i + 3]] for i in range(min(PART, n - 2))]
        yield np.array(at, np.int64)
    yield np.array([xxhash.xxh3_64_intdigest(f"={word}") & (DIMENSION - 1)], np.int64)


def word_features(word: str) -> np.ndarray:
    """All parts of a word in one."""
    return np.concatenate(list(word_parts(word)))


def split_words(text: str) -> tuple[list[str], np.ndarray | None]:
    """The words of a text that may be kept in memos, and a count by feature of the others, if there are any."""
    words = text.split()
    if not words or max(map(len, words)) <= LONG:
        return words, None
    counts, parts, n = np.zeros(DIMENSION, np.int64), [], 0
    for part in (part for w in words if len(w) > LONG for part in word_parts(plain(w))):
        parts.append(part)
        n += len(part)
        if n >= PART:
            counts += np.bincount(np.concatenate(parts), minlength=DIMENSION)
            parts, n = [], 0
    if parts:
        counts += np.bincount(np.concatenate(parts), minlength=DIMENSION)
    return [w for w in words if len(w) <= LONG], counts


class _Features(dict):
    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = found = word_features(plain(word))
        return found


class _Known(dict):
    """Word -> its row in ``scores`` (sums of the SVMs' weights) and ``sizes``; emptied by the caller before it is full."""

    def __init__(self, weights: np.ndarray, bound: int):
        self.matrix, self.bound = np.ascontiguousarray(weights.T), bound
        self.scores, self.sizes = np.zeros((bound, weights.shape[0])), np.zeros(bound)
        self.plain: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        key = plain(word)
        i = self.plain.get(key)
        if i is None:
            at = word_features(key)
            self.plain[key] = i = len(self.plain)
            self.scores[i], self.sizes[i] = self.matrix[at].sum(axis=0), len(at)
        self[word] = i
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > self.bound:
            self.clear()
            self.plain.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _known(weights: np.ndarray, bound: int) -> _Known:
    """One memo a worker process and model, so that its tasks share it."""
    return worker_memo(("weights", xxhash.xxh3_64_intdigest(weights.tobytes())), lambda: _Known(weights, bound))


def _vector(text: str, known: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their frequencies a word, scaled to unit length."""
    words, counts = split_words(text)
    if words or counts is None:
        at, n = np.unique(np.concatenate([known[w] for w in words or [""]]), return_counts=True)
    if counts is not None:
        if words:
            counts[at] += n
        at = np.flatnonzero(counts)
        n = counts[at]
    return at, n / np.sqrt((n.astype(float) ** 2).sum())


def fit_svm(vectors: list, signs: np.ndarray, strength: float = 1e-4, epochs: int = 5) -> np.ndarray:
    """A linear SVM by stochastic subgradients (hinge loss, L2), averaged over the last half of the steps."""
    w, total, scale, kept = np.zeros(DIMENSION), np.zeros(DIMENSION), 1.0, 0
    order = np.random.default_rng(7)
    step, steps = 0, epochs * len(vectors)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            step += 1
            rate = 1 / (strength * (step + 1 / strength))
            at, x = vectors[i]
            margin = signs[i] * scale * (w[at] @ x)
            scale *= 1 - rate * strength
            if margin < 1:
                w[at] += rate * signs[i] / scale * x
            if step * 2 > steps and step % 64 == 0:
                total += scale * w
                kept += 1
    return total / kept if kept else scale * w


class Models(NamedTuple):
    """``languages`` that were learned; SVM i says ``one[i]`` where ``weights[i]`` give a positive sum, else ``other[i]``.

    ``tree`` gives each node's children: of ROOT the families, or groups of them; of a family its languages.
    """

    languages: list[str]
    one: list[str]
    other: list[str]
    weights: np.ndarray
    tree: dict[str, list[str]]


ROOT = "root"


def family_tree(languages: list[str], most: int) -> dict[str, list[str]]:
    """Node -> children. Families of languages stand below the root; while that has more than ``most`` children, they are
    joined by name into groups of at most ``most``, so that the number of pairs that meet grows with that of languages."""
    tree: dict[str, list[str]] = {}
    for language in languages:
        tree.setdefault(f"family:{family_of(language)}", []).append(language)
    top, level = sorted(tree), 0
    while len(top) > most:
        level += 1
        groups = -(-len(top) // most)
        parts = [top[len(top) * i // groups : len(top) * (i + 1) // groups] for i in range(groups)]
        top = [f"group:{level}:{i:06d}" for i in range(groups)]
        tree.update(zip(top, parts, strict=True))
    tree[ROOT] = top
    return tree


def _below(tree: dict[str, list[str]], node: str) -> list[str]:
    """The languages below a node."""
    if node.startswith("family:"):
        return tree[node]
    return [x for child in tree[node] for x in _below(tree, child)] if node in tree else [node]


def train(docs: DataFrame, bound: int = 8_000, most: int = 16) -> Models:
    """The SVMs of families and of the languages of a family; every language that a row teaches is learned.

    Families meet as ``family:x``; languages only those of their own family; of more than ``most`` families, groups of them
    meet first (``family_tree``). At most ``bound`` rows teach (one a language, if there are more languages), as many of
    each language, of the smallest hashes of their ids, from rows with text and lang that aren't held out; rows of equal
    id, lang and text teach once. A task fits one SVM, of the rows of its two sides. There are a few SVMs of DIMENSION
    numbers for each language: a dozen for four languages, some 1,100 for 150 families.
    """
    digest = F.xxhash64("text").alias("digest")
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", digest, F.xxhash64("doc_id").alias("order"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return Models([], [], [], np.zeros((0, DIMENSION), np.float32), {ROOT: []})
    tree = family_tree(languages, most)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "digest"))
    chosen = known.withColumn("place", first).where(F.col("place") <= max(1, bound // len(languages))).select("doc_id", "lang", "digest").distinct()
    pairs = [(a, b, _below(tree, a), _below(tree, b)) for children in tree.values() for i, a in enumerate(children) for b in children[i + 1 :]]
    if not pairs:
        return Models(languages, [], [], np.zeros((0, DIMENSION), np.float32), tree)
    models = docs.sparkSession.createDataFrame([(a, b, x, s) for a, b, xs, ys in pairs for s, names in ((1, xs), (-1, ys)) for x in names], "one string, other string, lang string, sign int")
    taught = docs.select("doc_id", "lang", "text", digest).join(F.broadcast(chosen), ["doc_id", "lang", "digest"]).dropDuplicates(["doc_id", "lang", "digest"])
    rows = taught.join(F.broadcast(models), "lang").select("one", "other", "sign", "doc_id", "text")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        forget()
        part = part.sort_values(["doc_id", "text"])
        features = _Features()
        weights = fit_svm([_vector(text, features) for text in part.text], part.sign.to_numpy(float))
        return pd.DataFrame({"one": [key[0]], "other": [key[1]], "weights": [weights.astype(np.float32)]})

    fitted = rows.groupBy("one", "other").applyInPandas(fit, "one string, other string, weights array<float>").toPandas().sort_values(["one", "other"], ignore_index=True)
    return Models(languages, fitted.one.tolist(), fitted.other.tolist(), np.array(fitted.weights.tolist(), np.float32).reshape(len(fitted), DIMENSION), tree)


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row.

    By the families' SVMs (their groups' before, where there are many) and then those of the chosen family, the class that
    wins most pairs is taken, ties to the larger sum of margins, then by name. The score is the product over the steps of
    the winner's least confidence in its pairs. A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
    """
    languages, one, other, weights, tree = models
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    # The pairs of each node, by their places.
    node_of = {child: node for node, children in tree.items() for child in children}
    own: dict[str, list[tuple[str, str, int]]] = {node: [] for node in tree}
    for i, (a, b) in enumerate(zip(one, other, strict=True)):
        own[node_of[a]].append((a, b, i))
    bound = max(1 << 13, min(1 << 20, (1 << 23) // max(1, len(one))))

    def best(sums: np.ndarray, node: str) -> tuple[str, float]:
        among = tree[node]
        won, margins, least = dict.fromkeys(among, 0), dict.fromkeys(among, 0.0), dict.fromkeys(among, 1.0)
        for a, b, i in own[node]:
            margin = sums[i]
            won[a if margin > 0 else b] += 1
            sure = float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            for x, m, p in ((a, margin, sure), (b, -margin, 1 - sure)):
                margins[x] += m
                least[x] = min(least[x], p)
        top = min(among, key=lambda x: (-won[x], -margins[x], x))
        return top, least[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent.value, bound)
        for batch in batches_of(batches):
            found, sure = [], []
            for text in batch.column("text").to_pylist():
                if not languages or text is None or not _LETTER.search(text):
                    found.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                sums, n = np.zeros(len(one)), 0.0
                words, counts = split_words(text)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    sums += counts[at] @ known.matrix[at].astype(float)
                    n += counts.sum()
                for at in range(0, len(words), bound // 2):
                    rows = known.rows(words[at : at + bound // 2])
                    sums += known.scores[rows].sum(axis=0)
                    n += known.sizes[rows].sum()
                sums *= 16 / n
                node, p = ROOT, 1.0
                while not node.startswith("family:"):
                    node, q = best(sums, node)
                    p *= q
                language, q = best(sums, node)
                found.append(language)
                sure.append(p * q)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
