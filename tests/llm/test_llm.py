"""The training-data operators against brute force, round trips, held-out rows and awkward input."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meadowlark.llm import ann, audio, common, graph, html_text, langid, minhash, mixing, packing, pii, substring_dedup, toxicity
from meadowlark.llm import queries as llm_queries

from ..compare import duck, same

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, "en", "s", None), (None, "a b c", None, None, 5), (None, None, None, None, None), (3, "", "de", None, 0), (4, long, "fr", "s", len(long)), (5, " \t\n", "fr", "t", 3)]
    clash = ("node", "size", "key", "keys", "bucket", "value", "kept", "row", "taken", "hash", "rank", "chunk", "score", "found", "added", "id", "b", "a", "n", "sha", "text_key")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in clash})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1


def removed_by_hand(texts):
    counts = collections.Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for w in texts:
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 60_000, "group_rows": 200}])
def test_substring_dedup_is_brute_force(docs, sizes):
    r = substring_dedup.remove_repeats(docs, **sizes).collect()
    assert sorted((x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in r) == removed_by_hand([words(t.text) for t in docs.collect()])


def test_substring_dedup_shuffles_texts_no_more_often_for_hot_prefixes(spark, monkeypatch):
    texts = [" ".join(map(str, range(i, i + 60))) for i in (0, 0, 20, 90)] + ["x " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, jobs = substring_dedup.stored, []
    monkeypatch.setattr(substring_dedup, "stored", lambda part: jobs.append(part.columns) or kept(part))
    for group_rows in (1, 1 << 16):
        r = substring_dedup.remove_repeats(df, bucket_bytes=200, group_rows=group_rows).collect()
        assert sorted((x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in r) == removed_by_hand([words(t) for t in texts])
    assert jobs[:2] == jobs[2:]


def test_substring_dedup_repeats_inside_a_text(spark):
    texts = ["x " * 40, " ".join(map(str, range(50))) + " q " + " ".join(map(str, range(50))), "y " * 34, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = substring_dedup.remove_repeats(df).collect()
    assert sorted((x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in r) == removed_by_hand([words(t) for t in texts])


# --- 2


def test_mixing_equals_sql(spark):
    same(llm_queries.queries()["op2_mix_sources"](spark, FOLDER), duck(FOLDER), llm_queries.OP2_SQL)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 0)], "source string, source_size long")
    r = {x.source: x.target for x in mixing.source_targets(sizes).collect()}
    assert r["a"] == 30 and r["c"] == 0 and abs(sum(r.values()) - 2010) < 1e-6
    assert abs(r["b"] / r[None] - 2 / 5) < 1e-9  # weights in turn: a 5, b 2, c 1, null 5


def taken_by_hand(rows, weights=(5, 2, 1)):
    """How often each row (doc_id, text, source) is taken: its source in order of hashes, as long as that comes nearer."""
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = {s: sum(len(words(r[1])) for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weight[s] for s in sources if s not in capped) or 1)
        over = {s for s in sources if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s in sources:
        target = 3 * sizes[s] if s in capped else weight[s] * level
        whole = int(target // sizes[s]) if sizes[s] else 0
        left, before = target - whole * sizes[s], 0
        text_hash = lambda t: "null" if t is None else hashlib.md5(t.encode()).hexdigest()
        at = lambda i: hashlib.md5(f"{'null' if rows[i][0] is None else rows[i][0]}:{text_hash(rows[i][1])}".encode()).hexdigest()[:15]
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (int(at(i), 16), len(words(rows[i][1])))):
            n = len(words(rows[i][1]))
            out[i] = whole + (before * 2 + n <= left * 2)
            before += n
    return out


def test_mixing_repeats_each_row_by_its_own_source(spark):
    """Null ids in several sources, and rows without words: each row has the multiplicity of its own source and hash."""
    rows = [(None, "w " * 50, "a"), (None, "", "b"), (None, "v " * 20, "b"), (None, " \t", None), (None, "u " * 900, "c"), (7, None, "a"), (8, "x y", "a"), (8, "x y", "c"), (9, " ", "d")]
    rows += [(100 + i, "z " * (i % 7), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame([(d, t, "en", s, i) for i, (d, t, s) in enumerate(rows)], SCHEMA)
    expected = taken_by_hand(rows)
    mixed = corpus_pipeline.mix(spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.n_chars for r in mixed.collect()) == {i: n for i, n in expected.items() if n}
    assert collections.Counter((r.doc_id, r.source, r.taken) for r in mixing.mix_sources(docs).collect()) == collections.Counter((rows[i][0], rows[i][2], n * len(words(rows[i][1]))) for i, n in expected.items())


def test_mixing_of_repeated_rows(spark):
    """Rows that nothing tells apart are split at the budget, in both results."""
    rows = [(None, "w " * 100, "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], SCHEMA)
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 50
    by_hand = collections.Counter()
    for i, n in taken_by_hand(rows).items():
        by_hand[rows[i][2]] += n
    assert {r.source: r["count"] for r in mixing.repeat(docs).groupBy("source").count().collect()} == by_hand


# --- 3 and 8


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    r = llm_queries.op3_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    caught, false = ((r.predicted == 1) & (r.toxic == 1)).sum(), ((r.predicted == 1) & (r.toxic == 0)).sum()
    assert caught >= 0.75 * (r.toxic == 1).sum() and false <= 0.03 * (r.toxic == 0).sum()
    assert r.score.between(0, 1).all()


def test_ftrl_is_its_definition():
    """Against the update rule over plain dicts, and the features against plain n-grams and skip-grams."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["Du", "bad,", "ok", "x", "why?", "no"], rng.integers(0, 9))) for _ in range(300)]
    labels = [int("bad" in t) for t in texts]
    hasher, model = toxicity._PlainWords(), toxicity.Ftrl()
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        if f != "bias" and abs(z[f]) <= 4.0:
            return 0.0
        return ((z[f] > 0) * 2 - 1) * (0.0 if f == "bias" else 4.0) / ((1 + n[f] ** 0.5) / 2 + 0.1) - z[f] / ((1 + n[f] ** 0.5) / 2 + 0.1)

    for text, label in zip(texts, labels, strict=True):
        w = [x.lower().strip(",?") for x in text.split()]
        grams = {("1", x) for x in w} | {("2", *x) for x in zip(w, w[1:])} | {("s", *x) for x in zip(w, w[2:])}
        at = toxicity.features(text, hasher)
        assert len(at) == len(grams)
        model.learn(np.append(at, toxicity.DIMENSION), label)
        own = [*grams, "bias"]
        ws = {f: weight(f) for f in own}
        gradient = 1 / (1 + np.exp(-sum(ws.values()))) - label
        for f in own:
            z[f] += gradient - ((n[f] + gradient**2) ** 0.5 - n[f] ** 0.5) / 2 * ws[f]
            n[f] += gradient**2
        mine = model.weights(np.append(at, toxicity.DIMENSION))
        assert np.allclose(sorted(mine), sorted(weight(f) for f in own))


def test_toxic_stage_keeps_columns_of_the_caller(spark, docs):
    named = docs.withColumns({"score": F.lit(42.0), "predicted": F.lit("mine"), "_toxicity": F.lit(1)})
    kept = corpus_pipeline.drop_toxic(spark, named, FOLDER)
    assert kept.columns == named.columns and kept.where("score = 42.0 and predicted = 'mine' and _toxicity = 1").count() == kept.count() > 0


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    r = llm_queries.op8_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (r.lang == r.lang_pred).mean() >= 0.97 and r.score.between(0, 1).all()


def test_language_of_unspaced_texts(spark):
    """Texts of one chunk each, whose first 70 characters are the same in both languages; judged on rows that don't teach."""
    tail = lambda i: "".join(np.random.default_rng(i).choice(list("山川木火土" if i % 2 else "猫犬鳥魚馬"), 300))
    docs = spark.createDataFrame([(i, "同じ始まりの文" * 10 + tail(i), "zh" if i % 2 else "ja", "s", 370) for i in range(400)], SCHEMA)
    found = langid.predict(docs, langid.train(docs)).where(common.is_held_out(F.col("doc_id"))).collect()
    assert len(found) > 20
    assert all(r.lang_pred == ("zh" if r.doc_id % 2 else "ja") for r in found)


@pytest.mark.parametrize("n", [1, 39, 40, 41, 1 << 14, (1 << 14) - 2, (1 << 14) - 1, (1 << 14) + 1, (1 << 15) - 2, 40_000])
def test_language_runs_of_whole_words(n):
    """Each run of the whole word is counted once, whatever its length."""
    at = lambda run: langid.xxhash.xxh3_64_intdigest(run) & (langid.DIMENSION - 1)
    word = "".join(chr(0x4E00 + i * i % 977) for i in range(n))
    marked = f" {word} "
    by_hand = collections.Counter(at(marked[i : i + k]) for k in (1, 2, 3) for i in range(len(marked) - k + 1))
    by_hand[at(f"={word}")] += 1
    assert collections.Counter(langid.word_features(word).tolist()) == by_hand
    for text in (word, f"{word} ab cd", "ab " + word + " cd " + word):
        total = collections.Counter()
        for w in text.split():
            total.update(langid.word_features(w).tolist())
        places, x = langid._vector(text, langid._Features())
        counts = np.array([total[p] for p in places.tolist()], float)
        assert len(places) == len(total) and np.allclose(x, counts / np.sqrt((counts**2).sum()))


def test_language_of_nothing(spark, awkward):
    r = langid.predict(awkward, langid.train(empty(spark))).collect()
    assert len(r) == awkward.count() and {(x.lang_pred, x.score) for x in r} == {("und", 0.0)}
    one = langid.train(spark.createDataFrame([(1, "abc def", "xx", "s", 7)], SCHEMA))
    assert {x.lang_pred for x in langid.predict(awkward, one).collect()} == {"xx", "und"}


def test_every_language_is_learned(spark):
    """150 languages of their own letters, each with few rows: none is left out, and groups of families find them."""
    rng = np.random.default_rng(4)
    letters = [chr(0x3400 + 7 * i) for i in range(2000)]
    rows = []
    for i in range(150 * 12):
        own = letters[12 * (i % 150) : 12 * (i % 150) + 12]
        rows.append((i, " ".join("".join(rng.choice(own, 4)) for _ in range(30)), f"l{i % 150:03d}", "s", 150))
    docs = spark.createDataFrame(rows, SCHEMA)
    models = langid.train(docs, bound=900)
    assert len(models.languages) == 150 and max(map(len, models.tree.values())) <= 16 and len(models.one) < 150 * 16
    found = langid.predict(docs, models).where(common.is_held_out(F.col("doc_id"))).collect()
    assert len(found) > 300 and sum(x.lang_pred == f"l{x.doc_id % 150:03d}" for x in found) >= 0.97 * len(found)


def test_language_family_tree():
    tree = langid.family_tree(["de", "en", "fr", *(f"x{i:02d}" for i in range(40))], 4)
    assert max(len(x) for k, x in tree.items() if not k.startswith("family:")) <= 4 and sorted(langid._below(tree, langid.ROOT)) == sorted(["de", "en", "fr", *(f"x{i:02d}" for i in range(40))])
    assert langid.family_tree(["de", "en", "fr"], 16) == {"family:germanic": ["de", "en"], "family:romance": ["fr"], langid.ROOT: ["family:germanic", "family:romance"]}


def test_language_of_repeated_ids(spark):
    """A row teaches its own lang, not that of another row of its id; repeated rows teach once."""
    texts = {"fr": "le chat est sur la table et il mange", "en": "the cat is on the table and it eats"}
    rows = [(1, text, lang, "s", 40) for lang, text in texts.items()] + [(1, texts["en"], "en", "s", 40)] * 5 + [(1, "nothing known", None, "s", 13)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert not docs.where(common.is_held_out(F.col("doc_id"))).count()
    once = spark.createDataFrame(rows[:2], SCHEMA)
    models, plain = langid.train(docs), langid.train(once)
    assert np.array_equal(models.weights, plain.weights)
    for lang, text in texts.items():
        assert langid.predict(docs.where(F.col("text") == text).limit(1), models).first().lang_pred == lang


def test_language_votes_are_their_definition(spark, docs):
    """Predictions against plain sums over all runs of characters, pair by pair."""
    models = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs.limit(40), models).collect()}
    assert models.languages and len(models.one) == len(models.weights)
    for d in docs.limit(40).collect():
        if d.text is None or not any(c.isalpha() for c in d.text):
            assert got[d.doc_id].lang_pred == "und"
            continue
        counts = collections.Counter()
        for w in d.text.split():
            marked = f" {langid.plain(w)} "
            runs = [marked[i : i + k] for k in (1, 2, 3) for i in range(len(marked) - k + 1)] + [f"={langid.plain(w)}"]
            counts.update(langid.xxhash.xxh3_64_intdigest(run) & (langid.DIMENSION - 1) for run in runs)
        sums = {(a, b): 16 * sum(float(w[f]) * n for f, n in counts.items()) / sum(counts.values()) for a, b, w in zip(models.one, models.other, models.weights, strict=True)}

        def winner(among):
            votes = {x: (sum((m > 0) == (x == a) for (a, b), m in sums.items() if x in (a, b) and {a, b} <= set(among)), sum(m if x == a else -m for (a, b), m in sums.items() if x in (a, b) and {a, b} <= set(among))) for x in among}
            return max(sorted(among), key=lambda x: votes[x])

        family = winner([f"family:{f}" for f in sorted({langid.family_of(x) for x in models.languages})])
        assert got[d.doc_id].lang_pred == winner([x for x in models.languages if f"family:{langid.family_of(x)}" == family])


# --- 4


def test_packing_is_exact(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    r = packing.pack(packing.token_pieces(docs)).toPandas()
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0] for d in docs.collect()}
    for doc, piece, start, length, crc in zip(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, strict=True):
        assert start == piece * 2048 and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
    assert r.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in ids.items()}
    ordered = r.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 2048
    assert r.sequence_id.nunique() <= 1.03 * r.length.sum() / 2048 + 1


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing._encoder(packing.tokenizer_path())
    for text in ["it's DON'T (we'll) x_y 12ab3² ,é́a", "a<|startoftext|>b <|endoftext|>", "ß İstanbul Ⅷ ªº µm ``q''", "a\x1cb\x85c d　e"]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_memos_are_bounded_and_keep_what_is_asked_for():
    asked = []
    memo = packing._Memo(lambda key: asked.append(key) or key.encode(), 10)
    for i in range(1000):
        assert memo["often"] == b"often" and memo[f"once {i}"] == f"once {i}".encode()
        assert len(memo) + len(memo.old) <= 20
    assert asked.count("often") == 1


@pytest.mark.parametrize("counts", [{2048: 3}, {1: 5000}, {1000: 7, 1048: 3, 524: 9, 24: 2}, {700: 10, 648: 5, 1400: 3}, {1500: 4, 1400: 4}, {1024: 3}, {512: 9}])
def test_packing_plan_uses_every_piece_once(counts):
    plan = packing.pack_lengths(counts)
    used = collections.Counter()
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert dict(used) == counts


# --- 5


def base_by_hand(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


CASES = ["a@b@c.de.f x..y@z-1.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 1234", "+1 (257) 555-8854 +12 +123456789012345678", "@a.b a@.b a@b. é@x.yz", "+49.30.1234567 4111111111111111@x.org", "1" * 500 + ".1.1.1"]


def test_base_spans_are_the_patterns(docs):
    for text in [*CASES, *(d.text for d in docs.collect() if d.text)]:
        assert [(pii.KINDS[k], a, b) for a, k, b in pii.base_spans(text)] == base_by_hand(text)


def test_base_spans_of_long_runs_are_fast():
    pii.base_spans("a" * 2_000_000 + " " + "1" * 2_000_000 + "@" * 1000)


def test_contexts_discover_unseen_identifiers(spark):
    seen = [(i, f"please write to user{i}@mail.example.org today") for i in range(20)]
    df = spark.createDataFrame([*seen, (100, "please write to someone(at)hidden.example today"), (101, "nothing here 12.5")], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.find(df).withColumn("spans", pii.as_text(F.col("found"))).collect()}
    assert r[100].n_email == 0 and r[100].spans == "email:16:41" and r[101].spans == "" and r[3].spans == "email:16:38"
    assert pii.redact(df).where("doc_id = 100").first().text == "please write to [EMAIL] today"


def test_contexts_are_whole_words():
    long = "p" * 300
    assert pii._contexts(f"one {long} two 1.2.3.4 end", 307 + 2, 316)[0] != "" and pii._words_before(f"one {long} 9", 305) == ["one", long]
    assert pii._contexts(f"a {long} 9", 303, 304)[0] == pii._named(f"a {long} _") != pii._contexts(f"a {long}q 9", 304, 305)[0]
    host = "h" * 5000
    text = f"x {'n' * 500}@{host} q"
    assert list(pii._loose_emails(text)) == [(2, 2 + 500 + 1 + 5000)]
    pii._candidates("a(at)b" * 200_000 + "@" * 1000 + "n" * 1_000_000 + "@", [])


def discovered_by_hand(texts, rounds=3, support=5, confidence=0.9):
    """The same rounds over plain dicts."""
    seeds, values = collections.defaultdict(set), collections.defaultdict(set)
    for text in texts:
        base = pii.base_spans(text or "")
        for found, spans in ((seeds, base), (values, pii._candidates(text or "", base))):
            for a, k, b in spans:
                for c in pii._contexts(text, a, b):
                    found[c].add((k, text[a:b].lower()))
    known = set().union(*seeds.values()) if seeds else set()
    out = set()
    for kind in range(4):
        able = {c for c, found in seeds.items() if sum(k == kind for k, _ in found) >= support}
        beside = {c: seeds[c] | values[c] for c in able}
        score = {v: 1.0 for found in beside.values() for v in found if v in known and v[0] == kind}
        for _ in range(rounds):
            trust = {c: sum(score.get(v, 0.0) for v in found) / len(found) for c, found in beside.items()}
            fresh = collections.defaultdict(float)
            for c, found in beside.items():
                for v in found:
                    # A value that is a seed beside this context counts as one there.
                    fresh[v] = max(fresh[v], float(v[0] == kind) if v in seeds[c] else trust[c])
            score = dict(fresh)
        out |= {v for c, found in beside.items() for v in found if v not in seeds[c] and v[0] == kind and score[v] >= confidence}
    return out


def planted(n=300):
    """Texts with seeds of all kinds beside contexts that tell, identifiers of other forms beside them, and decoys."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    lead = ["write to {} today", "host {} answered", "card no {} expires", "call me at {} please"]
    seed = [lambda: f"{word()}@{word()}.org", lambda: ".".join(map(str, rng.integers(1, 255, 4))), lambda: "4111 1111 1111 1111", lambda: f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"]
    unseen = [lambda: f"{word()} (at) {word()}", lambda: f"{rng.integers(300, 999)}.1.{rng.integers(1, 255)}.7", lambda: f"{rng.integers(10**15, 10**16 - 1)}", lambda: f"0{rng.integers(100, 999)} {rng.integers(100, 999)} {rng.integers(100, 999)}"]
    texts, truth = [], set()
    for i in range(n):
        k = i % 4
        texts.append(f"{word()} {word()} {lead[k].format(seed[k]())} {word()}")
        if i % 5 == 0:
            value = unseen[k]()
            texts.append(f"{word()} {lead[k].format(value)} {word()}")
            truth.add((k, value))
        texts.append(f"{word()} {unseen[k]()} {word()}")
    return texts, truth


def test_contexts_are_the_graph_by_hand(spark):
    texts, truth = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"rounds": 1, "support": 3, "confidence": 0.5}, {"confidence": 0.99}):
        got = {(r.kind, r.value) for r in pii.discover(pii._scanned(docs), **options).collect()}
        assert got == discovered_by_hand(texts, **options)
    added = set()
    for r in pii.find(docs).withColumn("spans", pii.as_text(F.col("found"))).collect():
        text = texts[r.doc_id]
        own = {(a, b) for a, _, b in pii.base_spans(text)}
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert own <= {(a, b) for _, a, b in spans}
        added |= {(pii.KINDS.index(k), text[a:b]) for k, a, b in spans if (a, b) not in own}
    assert len(added & truth) >= 0.9 * len(added) and len(added & truth) >= 0.5 * len(truth)


# --- 6


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(30)]  # copies of a query
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (None, [1.0] * 8), (905, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "ids": F.lit(2)})
    r = ann.search(df, F.col("vec_id") % 50 == 0, block=100, query_block=3, reranked=80).toPandas()
    known = {i: np.array(v, np.float32).astype(float) for i, v in rows[:430]}
    hits = 0
    for q, got in r.groupby("query_id"):
        cos = {i: float(v @ known[q] / np.sqrt((v @ v) * (known[q] @ known[q]))) for i, v in known.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        got = got.sort_values("rank")
        assert list(got["rank"]) == [1, 2, 3, 4, 5] and all(abs(cos[i] - s) < 1e-12 for i, s in zip(got.vec_id, got.score, strict=True))
        hits += len(set(best) & set(got.vec_id))
    assert r.query_id.nunique() == 9 and hits >= 0.9 * 45
    assert list(r[r.query_id == 50].sort_values("rank").vec_id) == [400, 401, 402, 403, 404]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4 + 4 * (i % 2)).tolist()) for i in range(60)]
    r = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).collect()
    assert len(r) == 60 and all((x.query_id - x.vec_id) % 2 == 0 for x in r)


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(t.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = llm_queries.op6_permutation_index(spark, folder).toPandas().groupby("query_id").vec_id.apply(set)
    found = 0
    for i in np.flatnonzero(t.vec_id % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        found += len(set(t.vec_id.iloc[np.argsort(-s)[:5]]) & got[t.vec_id.iloc[i]])
    assert found >= 0.9 * 5 * len(got)


# --- 7


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href=a>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies on this page.</p></div>
%s<aside class="sidebar"><p>A sidebar with a long text that is not of the article, but is long enough to look like one.</p></aside>
<form>Subscribe <input name=q></form><section id="comments"><p>A reader's long comment about all this, which isn't of the article, although it is long.</p></section><footer>&copy; 2024</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>First <b>bold</b>\n  paragraph of the article, long enough to be seen as text by any measure of length at all.<p>Second&nbsp;one<br>goes on, and has enough characters to count as well.</p><div class='ad'>Buy!</div><p>End.</p>"
TEXT = "Head & line\n\nFirst bold paragraph of the article, long enough to be seen as text by any measure of length at all.\n\nSecond one goes on, and has enough characters to count as well.\n\nEnd."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>"])
def test_main_text_of_a_page(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == TEXT


@pytest.mark.parametrize(
    "wrap",
    [
        '<article class="post has-sidebar">%s</article>',
        '<article class="sidebar" id="comments">%s</article>',
        '<main class="no-sidebar">%s</main>',
        '<main id="search" role="complementary">%s</main>',
        '<div class="content comments-open">%s</div>',
        '<div class="content comments-open"><article>%s</article></div>',
        '<div class="content-sidebar-wrap"><article>%s</article></div>',
        '<div class="sidebar"><main>%s</main></div>',
        '<form id="form"><main>%s</main></form>',
        '<div class="widget"><div id="banner">%s</div></div>',
        '<main><p>Home</p><div class="sidebar-right"><article>%s</article></div></main>',
        '<div style="display:none"><article>%s</article></div>',
    ],
)
def test_main_text_of_marked_containers(wrap):
    junk = "<p>An unmarked line of the page beside the article, which is long enough to be seen as a surge of text.</p>"
    if "article" in wrap or "main" in wrap:
        expected = f"Home\n\n{TEXT}" if "Home" in wrap else TEXT
        assert html_text.main_text(PAGE % (junk + wrap % BODY)) == expected
        assert html_text.main_text(PAGE % (wrap % BODY + junk)) == expected
    elif "banner" in wrap:  # nothing names an article: marks count
        assert html_text.main_text(PAGE % (junk + wrap % BODY)) == re.sub("<.*?>", "", junk)
    else:
        assert html_text.main_text(PAGE % (wrap % BODY)) == TEXT


def test_main_text_leaves_out_articles_that_are_comments():
    others = '<div id="comments"><article class="comment-body"><p>A comment that is long.</p></article></div><aside><article><p>A teaser.</p></article></aside>'
    assert html_text.main_text(PAGE % (f"<article>{BODY}</article>{others}")) == TEXT
    assert html_text.main_text(PAGE % (f"<div>{BODY}</div><aside><article><p>A teaser.</p></article></aside>")) == TEXT


def test_main_text_leaves_out_marked_parts_of_a_line():
    for junk in ("<button>Subscribe now</button>", "<span class='ad'>Buy!</span>", "<i hidden>x</i>", "<a class='share-button' href=x>Share</a>"):
        assert html_text.main_text(PAGE % f"<article>{BODY.replace('<p>End.', f'<p>{junk}End.{junk}')}</article>") == TEXT
        assert html_text.main_text(PAGE % f"<div>{BODY.replace('<p>End.', f'<p>{junk}End.{junk}')}</div>") == TEXT


@pytest.mark.parametrize("kept", ["<div class='ad-hoc-analysis'>%s</div>", "<section class='section-legal-history'>%s</section>", "<p>%s <math><mi>x</mi></math></p>", "<object>%s</object>", "<noscript>%s</noscript>"])
def test_main_text_keeps_what_only_sounds_marked(kept):
    line = "A line of the article that stands in an element whose name or class sounds like another thing."
    want = f"{line} x" if "math" in kept else line
    assert html_text.main_text(PAGE % f"<article>{BODY}{kept % line}</article>") == f"{TEXT}\n\n{want}"


def test_main_text_of_several_articles():
    teaser = "<article><h2>Another</h2><p>Its teaser.</p></article>"
    comment = "<article><p>A reader's comment on the article, which is long enough to be seen as text by any measure.</p></article>"
    assert html_text.main_text(PAGE % f"<main><article>{BODY}{comment}<div id='comments'>{comment}</div></article></main>{teaser}{teaser}") == TEXT
    assert html_text.main_text(PAGE % f"<article>{BODY}</article><article>{BODY}</article>") == f"{TEXT}\n\n{TEXT}"


def test_main_text_keeps_short_articles():
    short = "<article><p>A short article of its own.</p></article>"
    for page in (f"{short}<article>{BODY}</article>", f"<main>{short}<article>{BODY}</article></main>", f"<main><p>A short article of its own.</p><article>{BODY}</article></main>"):
        assert html_text.main_text(PAGE % page) == f"A short article of its own.\n\n{TEXT}"
    assert html_text.main_text(PAGE % f"<article>{BODY}</article>{short}") == f"{TEXT}\n\nA short article of its own."


def test_main_text_is_where_the_distribution_surges(monkeypatch):
    """Short lines without marks before and after the article; without the distribution they would stay."""
    short = "".join(f"<p>{x}</p>" for x in ("Home", "News", "Sport", "Mail"))
    links = "<ul>" + "<li><a href=x>A long line of link text that leads elsewhere and isn't the article's</a>" * 4 + "</ul>"
    page = PAGE % f"{short}{links}<div>{BODY}</div>{links}{short}"
    assert html_text.main_text(page) == TEXT
    monkeypatch.setattr(html_text, "_between", lambda lines, sizes, surge: [x.text for x in lines if x.text])
    assert html_text.main_text(page) != TEXT


def test_main_text_of_empty_and_repeated_rows(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    rows = html_text.extract(spark.createDataFrame([(None, None, PAGE % BODY), (None, None, PAGE % BODY), (1, None, None)], schema)).collect()
    assert sorted((r.page_id or 0, r.text) for r in rows) == [(0, TEXT), (0, TEXT), (1, "")]


def test_main_text_of_odd_pages(spark):
    pages = ["", None, "plain words", "<p>a < b & c</p>", "<article><p>one<p>two", "<!-- x", "<script>x", "<" * 1000, "<a " * 2000, "<article>" + "<div>" * 3000 + "x", "<p title='>" + "y" * 5000]
    r = html_text.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumns({"url": F.lit("u"), "text": F.lit("clash")})).orderBy("page_id").collect()
    assert [x.text for x in r[:5]] == ["", "", "plain words", "a < b & c", "one\n\ntwo"]
    assert all(x.n_chars == len(x.text) for x in r)


def test_main_text_of_the_table(spark):
    for p in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = p.html.split("<article>")[1].split("</article>")[0]
        plain = [re.sub(r"\s+", " ", x).strip() for x in __import__("html").unescape(re.sub(r"</?(?:p|h1)>", "\x00", re.sub(r"</?b>|<br>", "", inner))).split("\x00")]
        assert html_text.main_text(p.html) == "\n\n".join(x for x in plain if x)


# --- 9


def test_audio_round_trip(spark, awkward):
    for df in (awkward, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        r = audio.media_features(df).collect()
        assert len(r) == df.count()
        by_doc = sorted((d.doc_id is None, d.doc_id or 0, d.text or "") for d in df.collect())
        for (_, _, text), x in zip(by_doc, sorted(r, key=lambda x: (x.doc_id is None, x.doc_id or 0, audio.samples_of(x.media)[1].rstrip(b"\xff"))), strict=True):
            data = audio.pad(text.encode())
            assert audio.samples_of(x.media)[1] == data and x.payload_bytes == len(data) and x.n_bytes == len(text.encode())
            assert x.payload_sha256 == hashlib.sha256(data).hexdigest() and x.tail_crc32 == zlib.crc32(data[-32:])
            spans, energies = audio.read_segments(x.segments)
            assert len(spans) == len(energies) > 0 and energies.shape[1:] == (8, 24)
    with pytest.raises(ValueError):
        audio.samples_of(b"RIFF" + struct.pack("<I", 4) + b"WAVE")


def test_resampling_and_segments():
    t = np.arange(4000) / audio.RATE
    y = audio.resample(np.sin(2 * np.pi * 440 * t))
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / 8000)
    lag = min(range(-3, 4), key=lambda k: np.abs(np.roll(y, k) - want)[100:-100].max())
    assert np.abs(np.roll(y, lag) - want)[100:-100].max() < 0.2 and np.abs(audio.resample(np.sin(2 * np.pi * 9000 * t)))[100:-100].max() < 0.05
    assert audio.segments(np.array([0.0, 0, 1, 0.2, 0.05, 0, 0, 1, 1])) == [(2, 4), (7, 9)] and audio.segments(np.zeros(4)) == [(0, 4)]


def features_by_hand(data):
    """The features by their definitions: convolution at the common rate, a Fourier sum, and loops."""
    x = np.frombuffer(data, np.uint8) / 128 - 1
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    n = np.arange(taps * up) - (taps * up - 1) / 2
    low_pass = 0.9 / down * np.sinc(0.9 / down * n) * np.kaiser(taps * up, 8.0) * up
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    sound = np.convolve(wide, low_pass)[taps // 2 * up :: down][: -(-len(x) * up // down)]
    frames = [sound[i : i + audio.FRAME] for i in range(0, len(sound) - audio.FRAME + 1, audio.HOP)] or [np.append(sound, np.zeros(audio.FRAME - len(sound)))]
    rate = audio.RATE * up / down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(60), mel(rate / 2), audio.BANDS + 2)]
    energies = []
    for frame in frames:
        power = [abs(sum(frame * np.hanning(audio.FRAME) * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        weigh = lambda f, a, b, c: max(0, min((f - a) / (b - a), (c - f) / (c - b)))
        energies.append([np.log(sum(weigh(k * rate / audio.FRAME, *edges[b : b + 3]) * p for k, p in enumerate(power)) + 1e-8) for b in range(audio.BANDS)])
    energies = np.array(energies)
    level, on, spans = energies.mean(axis=1), None, []
    for i, e in enumerate(level - np.median(level)):
        if on is None and e > 0.3:
            on = i
        elif on is not None and e < 0.1:
            spans.append((on, i))
            on = None
    spans = spans + [(on, len(level))] * (on is not None) or [(0, len(level))]
    steps = []
    for a, b in spans:
        cut = [a + i * (b - a) / audio.STEPS for i in range(audio.STEPS + 1)]
        lows = [min(int(c), b - 1) for c in cut[:-1]]
        steps.append([energies[lo : max(int(np.ceil(c)), lo + 1)].mean(axis=0) for lo, c in zip(lows, cut[1:], strict=True)])
    return np.array(spans) * audio.HOP / rate, np.array(steps)


def test_audio_features_are_their_definitions(docs):
    for text in ["", "a b", *(d.text for d in docs.where("length(text) between 1500 and 9000").orderBy("doc_id").limit(4).collect())]:
        data = audio.pad(text.encode())
        spans, energies = audio.read_segments(audio.stored_segments(*audio.features(audio.wav(data))))
        want_spans, want = features_by_hand(data)
        assert np.allclose(spans, want_spans) and np.abs(energies - want).max() < 2e-3
    assert audio.SEGMENTS.field("energies").type == pa.fixed_shape_tensor(pa.float32(), [8, 24])


# --- 10


def classes_by_hand(rows):
    units = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        units[doc] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, ta) in enumerate(rows):
        for b, tb in rows[:i]:
            if ta is None or tb is None:
                continue
            u, v = units[a], units[b]
            alike = ta == tb or u and v and sum((u & v).values()) >= 0.8 * sum((u | v).values())
            if alike:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d, _ in rows}


def test_near_duplicates_are_brute_force(docs):
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == classes_by_hand(rows)


def test_near_duplicates_of_dense_groups(spark):
    """Texts around the threshold in one bucket, so that components meet in all rounds."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        text = list(base)
        for j in rng.choice(120, rng.integers(1, 6), replace=False):
            text[j] = f"x{i}_{j}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)


def test_one_document_of_each_class_stays(spark):
    """Against the classes, by hand: ids of several texts, null ids and a column that clashes."""
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    rows = [(3, two, 1), (5, one, 2), (5, two, 3), (7, two, 4), (9, one, 5), (9, one, 5), (11, "", 6), (12, None, 7), (None, two, 8), (None, two, 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    own = {r.doc_id for r in minhash.near_duplicates(df).collect() if r.doc_id is not None and r.doc_id == r.class_id}
    kept = minhash.keep_one(df).collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == own == {3, 5, 11, 12}
    assert sorted((r.text for r in kept if r.doc_id is None), key=str) == sorted([two, None], key=str)
    assert {(r.doc_id, r.text) for r in kept if r.doc_id == 5} <= {(5, one), (5, two)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    one, two = (minhash.dart_signature(np.concatenate([shared, x]), 2048) for x in (a, b))
    assert abs((one == two).mean() - 0.8) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    r = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert r == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# --- all


def test_awkward_rows(spark, awkward):
    n = awkward.count()
    assert substring_dedup.remove_repeats(awkward).count() == n
    mixed = mixing.mix_sources(awkward).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    assert packing.pack(packing.token_pieces(awkward)).count() >= n
    assert pii.find(awkward).count() == n and pii.redact(awkward).count() == n
    near = [(r.doc_id, r.class_id) for r in minhash.near_duplicates(awkward).collect()]
    assert sorted(near, key=str) == sorted([(1, 1), (1, 1), (2, 2), (None, 1), (None, None), (3, 3), (4, 4), (5, 5)], key=str)
    kept = minhash.keep_one(awkward)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5] and kept.columns == awkward.columns
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, 0), (4, None)], "doc_id long, toxic int")
    scored = toxicity.score(awkward, toxicity.train(awkward, labels)).collect()
    assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
    assert langid.predict(awkward, langid.train(awkward)).count() == n


def test_empty_tables(spark):
    df = empty(spark)
    assert substring_dedup.remove_repeats(df).count() == 0
    assert mixing.mix_sources(df).count() == 0
    assert packing.pack(packing.token_pieces(df)).count() == 0
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0
    assert minhash.near_duplicates(df).count() == 0 and minhash.keep_one(df).count() == 0
    assert audio.media_features(df).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.train(df, labels)).count() == 0


def test_pipeline_stages(spark, docs):
    """Each stage on what its predecessor kept, checked against its operator or by hand."""
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    clean = common.stored(stage["toxicity"](spark, docs, FOLDER))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert clean.columns == docs.columns and clean.join(labels.where("toxic = 0"), "doc_id").count() >= 0.95 * docs.join(labels.where("toxic = 0"), "doc_id").count()
    single = common.stored(stage["near_duplicates"](spark, clean, FOLDER))
    assert {r.doc_id for r in single.collect()} == set(classes_by_hand([(r.doc_id, r.text) for r in clean.collect()]).values())
    masked = common.stored(stage["personal_data"](spark, single, FOLDER))
    assert masked.count() == single.count() and not any(base_by_hand(r.text or "") for r in masked.collect()) and all(r.n_chars == len(r.text) for r in masked.collect() if r.text is not None)
    mixed = common.stored(stage["mixing"](spark, masked, FOLDER))
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(masked).where("size > 0").collect()}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {d: t for d, t in taken.items() if t}
    packed = stage["packing"](spark, mixed, FOLDER).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and packed[packed.piece == 0].shape[0] == mixed.count()
