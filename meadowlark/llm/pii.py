"""Personal data: base patterns, and spans found by contexts that were bootstrapped from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, forget, small_batches, stored

#: In the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, as the last part takes a whole run: looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What an unseen identifier of a kind may look like; contexts decide. Those of emails are found around a separator.
_LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9]{1,5}(?:[.:][0-9]{1,5}){3,7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7})(?![0-9A-Za-z:.])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])[(]?[0-9]{2,5}[)]?(?:[ ./-]?[0-9]{2,5}){2,5}(?![0-9A-Za-z])"),
}
_AT = re.compile(r"@|\s?[\[(]at[\])]\s?")
_HOST = re.compile(r"[^\s@]{2,}")
#: Words of a context: runs of letters, runs of digits, single other characters. Longer contexts are named by a hash.
_TOKEN, _BACK = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_"), 64
_LONG = 96


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.domain, around each @, so that long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base patterns' matches that pass their tests, in this order."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(spans)


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """name@host and name (at) host without any rule for either side; each character is looked at a few times at most."""
    end = 0
    for m in _AT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace() and text[start - 1] != "@":
            start -= 1
        if start < m.start() and (host := _HOST.match(text, m.end())):
            yield start, host.end()
            end = host.end()
        else:
            end = m.end()


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose matches that overlap no base span and no earlier candidate."""
    taken = sorted((a, b) for a, _, b in base)
    found: list[tuple[int, int, int]] = []
    loose = sorted([(a, 0, b) for a, b in _loose_emails(text)] + [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) if kind in _LOOSE for m in _LOOSE[kind].finditer(text)])
    i, end = 0, 0
    for a, k, b in loose:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            found.append((a, k, b))
            end = b
    return found


def _words_before(text: str, end: int, n: int = 2) -> list[str]:
    """The last ``n`` words before a place, first to last, whole however long they are."""
    back = _BACK
    while True:
        start = max(0, end - back)
        found = [m[0] for m in _TOKEN.finditer(text, start, end)]
        # The first word may be cut where the look back starts, so one more is asked for.
        if start == 0 or len(found) > n:
            return found[-n:]
        back *= 4


def _words_after(text: str, start: int) -> list[str]:
    m = _TOKEN.search(text, start)
    return [m[0]] if m else []


def _named(context: str) -> str:
    return context if len(context) <= _LONG else f"#{xxhash.xxh3_128_hexdigest(context)}"


def _contexts(text: str, start: int, end: int) -> list[str]:
    """The two words before a span, and the word before with the word after."""
    before, after = [w.lower() for w in _words_before(text, start)], [w.lower() for w in _words_after(text, end)]
    return [_named(f"{' '.join(before)} _"), _named(f"{before[-1] if before else '^'} _ {after[0] if after else '$'}")]


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches_of(batches):
        columns: list[list] = [[], [], []]
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            more = _candidates(text, base) if "@" in text or "at" in text and ("(at" in text or "[at" in text) or _DIGIT.search(text) else []
            seen = [[{"start": a, "kind": k, "end": b, "value": text[a:b].lower(), "contexts": _contexts(text, a, b)} for a, k, b in spans] for spans in (base, more)]
            joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            for column, x in zip(columns, (*seen, hashlib.sha256(joined.encode()).hexdigest()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(c, pa.list_(_SPAN)) for c in columns[:2]), pa.array(columns[2], pa.string())], ["doc_id", "text_key", "base", "more", "base_sha256"])


_SPAN_DDL = "array<struct<start:long,kind:int,end:long,value:string,contexts:array<string>>>"


def discover(scanned: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """(kind, value) of unseen identifiers that high-confidence contexts stand beside.

    A graph links contexts and the values that they stand beside. Values of base spans are seeds with score 1 for their
    kind. Each round scores a context for a kind by the mean score of all its values, if it has ``support`` seeds at
    least, and then an unseen value by its best context. Values that end at ``confidence`` or more are found. The graph
    is aggregated by (context, value) before it is joined, so a common context or value is one row for each partner;
    a context's score is summed partly before the shuffle, and the contexts that have one go to the edges by their size.
    """
    def edges(column: str) -> DataFrame:
        span = scanned.select(F.explode(column).alias("span"))
        return span.select("span.kind", "span.value", F.explode("span.contexts").alias("context"), F.lit(column == "base").alias("seed"))

    graph = edges("base").union(edges("more")).groupBy("context", "kind", "value").agg(F.max("seed").alias("seed"))
    graph = stored(graph)
    # Contexts with too few seeds of a kind never matter, nor do values that only they reach.
    able = graph.where("seed").groupBy("context", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support).select("context", F.col("kind").alias("of"))
    graph = stored(graph.join(able, "context"))
    scores = graph.where("seed and kind = of").select("of", "kind", "value", F.lit(1.0).alias("score")).distinct()
    for _ in range(rounds):
        contexts = graph.join(scores, ["of", "kind", "value"], "left").groupBy("context", "of").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("trust"))
        fresh = graph.join(contexts, ["context", "of"]).groupBy("of", "kind", "value").agg(F.max(F.when(F.col("seed"), F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0)).otherwise(F.col("trust"))).alias("score"))
        scores = stored(fresh)
    unseen = graph.where("not seed and kind = of").select("of", "kind", "value").distinct()
    return scores.join(unseen, ["of", "kind", "value"]).where(F.col("score") >= confidence).select("kind", "value").distinct()


def _scanned(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return stored(keyed.mapInArrow(_scan, f"doc_id long, text_key long, base {_SPAN_DDL}, more {_SPAN_DDL}, base_sha256 string"))


def _added(scanned: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """_span_doc, _span_text and _spans: the spans of discovered values, by document. Repeated rows count once."""
    spans = scanned.select(F.col("doc_id").alias("_span_doc"), F.col("text_key").alias("_span_text"), F.explode("more").alias("span")).select("_span_doc", "_span_text", "span.start", "span.kind", "span.end", "span.value")
    hits = spans.join(discover(scanned, rounds, support, confidence), ["kind", "value"], "left_semi")
    return hits.groupBy("_span_doc", "_span_text").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("_spans"))


def _counter(kind: int) -> Callable[[Column, Column], Column]:
    return lambda n, span: n + (span["kind"] == kind).cast("long")


def find(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, and
    ``found``: all spans as (start, kind, end) in code points, by start and then kind.

    Base spans are what the four patterns match; contexts learned from all documents add spans (see ``discover``), of
    the kind that they look like, where no base span is. A null or empty text has none. Whole texts are searched;
    columns other than doc_id and text are ignored. Repeated rows have equal results, and teach the contexts once.
    """
    scanned = _scanned(docs)
    added = _added(scanned, rounds, support, confidence)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    counts = [F.aggregate("base", F.lit(0).cast("long"), _counter(k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    both = scanned.join(added, F.col("doc_id").eqNullSafe(F.col("_span_doc")) & (F.col("text_key") == F.col("_span_text")), "left")
    return both.select("doc_id", *counts, "base_sha256", F.array_sort(F.concat(base, F.coalesce("_spans", none))).alias("found"))


def redact(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """``docs`` with [EMAIL], [IP], [CARD] or [PHONE] in place of every span that ``find`` gives, and n_chars to match.

    Of overlapping spans the first one is named; all are covered. Null texts stay null. The texts are joined only with
    documents to which contexts add spans; base spans are found again on the way. These documents are stored first, so
    that Spark knows how few they are: it broadcasts their spans up to its threshold, and shuffles the texts beyond it.
    """
    added = stored(_added(_scanned(docs), rounds, support, confidence))
    names = docs.columns
    joined = docs.join(added, F.col("doc_id").eqNullSafe(F.col("_span_doc")) & (F.xxhash64("text") == F.col("_span_text")), "left").select(*names, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches_of(batches):
            texts = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                if text:
                    at, out = 0, []
                    for start, kind, end in sorted([*base_spans(text), *((s["start"], s["kind"], s["end"]) for s in more or ())]):
                        if start >= at:
                            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
                        at = max(at, end)
                    text = "".join([*out, text[at:]]) if at else text
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = joined.mapInArrow(run, fields)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def as_text(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))
