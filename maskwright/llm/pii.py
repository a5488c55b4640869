"""Personal data: patterns find protected values, corpus co-occurrence finds words that give them away.

A word discloses a value when knowing the word makes the value near certain: of all documents with the word a
large part hold the value, measured as information gained over the value's own frequency. Such words are marked
as well, in all texts, and spans are replaced by what kind of thing they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import materialize

#: Kinds in the order of equal starts.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>|*&%$#"
SPACE = "\x20\t\n\x0b\x0c\r"
#: Different texts a pair needs, and how many by the mean number of different least hashes (of SKETCHES); least
#: share of the word's texts that hold the value, and least information gained (bits).
LEAST_TEXTS = 3
LEAST_DIFFERENT = 2.5
SKETCHES = 4
LEAST_SHARE = 0.5
LEAST_BITS = 6.0
BROADCAST_TERMS = 1_000_000
#: Bytes of telling words up to which every task has all of them; characters of texts that are handled at once.
BROADCAST_BYTES, PIECE_CHARS = 16 << 20, 1 << 20
REPLACEMENT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[REDACTED]"}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found from their at signs, so that long words cost no more than their length."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the protected values of a text, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words of a text that touch none of its spans, without surrounding punctuation."""
    k, reach = 0, 0  # furthest end of the spans that start before the word's end
    for m in WORD.finditer(text):
        word = m.group()
        kept = word.strip(EDGE)
        if kept and any(c.isalpha() for c in kept):
            at = m.start() + word.index(kept)
            while k < len(spans) and spans[k][0] < at + len(kept):
                reach = max(reach, spans[k][2])
                k += 1
            if reach <= at:
                yield kept.lower(), at, at + len(kept)


def _shown(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)


def _sketch(words: list[str]) -> list[int]:
    """Least hashes of the word triples of a text."""
    triples = {" ".join(words[k : k + 3]).encode() for k in range(max(1, len(words) - 2))}
    return np.array([np.frombuffer(hashlib.blake2b(t, digest_size=8 * SKETCHES).digest(), "<i8") for t in triples]).min(0).tolist()


def _pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts (column `at`) have about `PIECE_CHARS` bytes together, or one longer text."""
    for batch in batches:
        size = batch.column(at).cast(pa.large_string())
        ends = np.cumsum(np.array(pa.compute.binary_length(size).fill_null(0), dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + PIECE_CHARS, side="right")))
            yield batch.slice(first, end - first)
            first = end


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row of `docs` (doc_id, text_id, text) and its different values.

    Columns: doc_id, text_id, n_email, n_ip, n_card, n_phone, base_sha256, base (joined spans), held (values), and for
    texts that hold any: words (different ones), sketch (least hashes of word triples).
    """
    schema = "doc_id long, text_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, held array<string>, words array<string>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, 2):
            counts, shas, bases, held, terms, least = ([], [], [], []), [], [], [], [], []
            for text in part.column(2):
                text = text.as_py() or ""
                spans = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                bases.append(_shown([(s, KINDS[k], e) for s, k, e in spans]))
                shas.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                held.append(sorted({KINDS[k] + ":" + text[s:e].lower() for s, k, e in spans}))
                own = [w for w, _, _ in _words(text, spans)] if spans else []
                terms.append(sorted(set(own)))
                least.append(_sketch(own) if spans else [])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(bases, pa.string()), *[pa.array(x, pa.list_(pa.string())) for x in (held, terms)], pa.array(least, pa.list_(pa.int64()))],
                names=["doc_id", "text_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "held", "words", "sketch"],
            )

    return docs.select("doc_id", "text_id", "text").mapInArrow(run, schema)


class Finder:
    """Finds words of a list in texts: one automaton runs over a text, and only what stands alone as a word counts."""

    def __init__(self, words: frozenset[str]) -> None:
        self.words = words
        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def present(self, text: str) -> set[str]:
        """The different words of the list among the words of a text."""
        if not self.words:
            return set()
        if "\u03a3" in text:  # the small form of a capital sigma depends on its neighbours
            return {w for w, _, _ in _words(text, [])} & self.words
        low, out = text.lower(), set()
        for end, word in self.automaton.iter(low):
            if word not in out:
                left, right = end - len(word), end + 1
                while left >= 0 and low[left] in EDGE:
                    left -= 1
                while right < len(low) and low[right] in EDGE:
                    right += 1
                if (left < 0 or low[left] in SPACE) and (right == len(low) or low[right] in SPACE):
                    out.add(word)
        return out

    def spans(self, text: str, own: list[str] | None = None) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of the values of a text and of words that touch no value: those of the list, or `own`."""
        spans = base_spans(text)
        wanted = set(own) if own else self.present(text)
        return sorted([*spans, *((s, len(KINDS), e) for w, s, e in _words(text, spans) if w in wanted)]) if wanted else spans


def _standing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term): every row of `texts` (text_id, text) once for each of `terms` in it."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        words = F.transform(F.split(F.lower("text"), "[ \\t-\\r]+"), lambda w: F.trim(w, F.lit(EDGE)))
        return texts.select("text_id", F.explode(F.array_distinct(words)).alias("term")).join(terms, "term", "left_semi")
    wanted = frozenset(r["term"] for r in terms.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(wanted)
        for part in _pieces(batches, 1):
            found = [sorted(finder.present(text.as_py())) for text in part.column(1)]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([w for f in found for w in f], pa.string())], names=["text_id", "term"])

    return texts.select("text_id", "text").mapInArrow(run, "text_id string, term string")


def telling_words(texts: DataFrame, scanned: DataFrame, least_share: float = LEAST_SHARE, least_bits: float = LEAST_BITS) -> tuple[DataFrame, int]:
    """(term) and how many: words that give a value away, by co-occurrence in whole texts over the whole corpus.

    Equal texts count once (each row of m equal ones as 1/m). A pair of word and value is weighed when it stands
    together in `LEAST_TEXTS` texts that also differ as wholes (near copies of one text have mostly the same least
    hashes and count as little more than one); it discloses when at least `least_share` of the texts with the word
    hold the value and the word tells `least_bits` bits about it: log2(P(value | word) / P(value)).
    """
    copies, n_texts = materialize(scanned.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"), F.first("held").alias("held")).withColumn("one", F.lit(1)), "one")
    held = copies.where(F.size("held") > 0).select("text_id", F.explode("held").alias("value"))
    # no word can tell enough bits about a value in more texts than this
    values = held.groupBy("value").agg(F.count(F.lit(1)).alias("holding")).where((F.col("holding") >= LEAST_TEXTS) & (F.col("holding") <= n_texts / 2**least_bits))
    values = values.withColumn("value_key", F.xxhash64("value"))
    holders = held.join(values, "value").groupBy("text_id").agg(F.collect_list(F.struct("value_key", "holding")).alias("values"), F.max("holding").alias("widest"))
    worded, n_held = materialize(
        scanned.where(F.size("held") > 0).select("text_id", "words", "sketch").join(holders, "text_id").dropDuplicates(["text_id"]).drop("text_id").withColumn("one", F.lit(True)), "one"
    )
    nothing = scanned.select(F.col("text_id").alias("term")).where("false"), 0
    if n_held == 0:
        return nothing
    # a word stands in at least the texts that hold some value, so most words are ruled out before any pair or count
    beside = (
        worded.select(F.explode("words").alias("term"), "widest").groupBy("term").agg(F.count(F.lit(1)).alias("beside"), F.max("widest").alias("widest"))
        .where((F.col("beside") >= LEAST_TEXTS) & (least_share * F.col("beside") <= F.col("widest"))).drop("widest")
    )
    beside, n_beside = materialize(beside.withColumn("one", F.lit(True)), "one")
    beside = F.broadcast(beside) if n_beside <= BROADCAST_TERMS else beside
    pairs = (
        worded.select(F.explode("words").alias("term"), "values", "sketch").join(beside, "term")
        .select("term", "sketch", "beside", F.explode(F.filter("values", lambda v: v["holding"] >= least_share * F.col("beside"))).alias("v"))
        .select("term", "sketch", "beside", "v.value_key", "v.holding")
    )
    support = (
        pairs.groupBy("value_key", "term", "holding", "beside").agg(F.count(F.lit(1)).alias("together"))
        .where((F.col("together") >= LEAST_TEXTS) & (F.col("together") >= least_share * F.col("beside")))
    )
    support, n_pairs = materialize(support.drop("beside").withColumn("one", F.lit(True)), "one")
    if n_pairs == 0:
        return nothing
    wanted = support.select("value_key", "term")
    apart = (
        pairs.join(F.broadcast(wanted) if n_pairs <= BROADCAST_TERMS else wanted, ["value_key", "term"], "left_semi")
        .select("value_key", "term", F.posexplode("sketch").alias("k", "least")).groupBy("value_key", "term", "k", "least").agg(F.lit(1).alias("one"))
        .groupBy("value_key", "term").agg((F.count(F.lit(1)) / SKETCHES).alias("different"))
    )
    weighed, n_pairs = materialize(support.join(apart.where(F.col("different") >= LEAST_DIFFERENT), ["value_key", "term"]).withColumn("one", F.lit(True)), "one")
    if n_pairs == 0:
        return nothing
    again, n_again = materialize(copies.where("copies > 1").select("text_id", "copies").withColumn("one", F.lit(True)), "one")
    standing = _standing(texts, materialize(weighed.select("term").distinct())[0]).join(F.broadcast(again) if n_again <= BROADCAST_TERMS else again, "text_id", "left")
    counts = standing.groupBy("term").agg(F.round(F.sum(1 / F.coalesce("copies", F.lit(1)))).alias("texts_with"))
    share = F.col("together") / F.col("texts_with")
    telling = weighed.join(counts, "term").where((share >= least_share) & (F.log2(share * n_texts / F.col("holding")) >= least_bits)).select("term").distinct()
    return materialize(telling.withColumn("one", F.lit(True)), "one")


def _with_words(texts: DataFrame, text_col: str, telling: DataFrame, n_telling: int) -> tuple[DataFrame, frozenset[str]]:
    """`texts` and the telling words that every task gets; where these are too many, each row has its own in a last column instead."""
    if n_telling == 0:
        return texts, frozenset()
    size = telling.agg(F.sum(F.octet_length("term") + 64)).first()[0]
    if size <= BROADCAST_BYTES:
        return texts, frozenset(r["term"] for r in telling.collect())
    named = texts.toDF(*[f"c{k}" for k in range(len(texts.columns))])
    text = F.coalesce(F.col(f"c{texts.columns.index(text_col)}"), F.lit(""))
    keyed = named.withColumn("text_id", F.sha2(F.encode(text, "UTF-8"), 256))
    own = _standing(keyed.select("text_id", text.alias("text")), telling).groupBy("text_id").agg(F.collect_set("term").alias("found"))
    return keyed.join(own, "text_id", "left").select(*named.columns, "found"), frozenset()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_id"), text.alias("text"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document.

    `spans` are kind:start:end in code points, end exclusive, by start and then kind, joined with commas: all
    values the patterns find, and words (kind 'term') that disclose one of them. Words that touch a value's
    span are never marked on their own.

    Null and empty texts have no spans. Repeated rows each give a row, equal texts have equal spans. Null ids
    stay. Extra columns are ignored; an empty table gives no rows.
    """
    texts = _named(docs, id_col, text_col)
    scanned, _ = materialize(scan(texts))
    telling, n_telling = telling_words(texts, scanned)
    counted = ["n_email", "n_ip", "n_card", "n_phone"]
    if n_telling == 0:
        return scanned.select("doc_id", "text_id", *counted, "base_sha256", F.col("base").alias("spans"))
    rows, words = _with_words(texts, "text", telling, n_telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(words)
        for part in _pieces(batches, 2):
            counts, shas, shown = ([], [], [], []), [], []
            own = part.column(3).to_pylist() if part.num_columns > 3 else [None] * part.num_rows
            for text, found in zip(part.column(2), own):
                spans = finder.spans(text.as_py(), found)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                named = [(s, (*KINDS, TERM)[k], e) for s, k, e in spans]
                shas.append(hashlib.sha256(_shown([x for x in named if x[1] != TERM]).encode()).hexdigest())
                shown.append(_shown(named))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(shown, pa.string())],
                names=["doc_id", "text_id", *counted, "base_sha256", "spans"],
            )

    return rows.mapInArrow(run, "doc_id long, text_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def generalised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by what it is; where spans overlap, the first one names the whole."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], REPLACEMENT[(*KINDS, TERM)[kind]]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of `find` replaced by what it is; where spans overlap, the first one names the whole.

    Texts are replaced where their rows lie: only the telling words come in. Null texts stay null, all other columns as they are.
    """
    texts = _named(docs, id_col, text_col)
    scanned, _ = materialize(scan(texts).select("text_id", "held", "words", "sketch"))
    telling, n_telling = telling_words(texts, scanned)
    rows, words = _with_words(docs, text_col, telling, n_telling)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(words)
        for part in _pieces(batches, at):
            own = part.column(len(names)).to_pylist() if part.num_columns > len(names) else [None] * part.num_rows
            made = []
            for text, found in zip(part.column(at), own):
                text = text.as_py()
                made.append(None if text is None else generalised(text, finder.spans(text, found)))
            columns = [part.column(k) for k in range(len(names))]
            columns[at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
