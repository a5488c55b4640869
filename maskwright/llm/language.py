"""Language of documents by error-correcting output codes over byte trigrams.

Every language has a codeword; for every bit a binary trigram classifier tells languages with 1 from those with 0.
A document's language is the codeword with the smallest loss against the bits' margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.bytesops import text_chunks

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
#: Up to this many languages get every possible bit, more get seeded random codewords of BITS_PER_DOUBLING bits per doubling.
EXHAUSTIVE = 6
BITS_PER_DOUBLING = 10
MOST_LANGUAGES = 512
#: Added to every count, in parts of the mean count.
SMOOTHING = 0.5
#: The second-best codeword's share above which a document is flagged.
AMBIGUOUS_SHARE = 0.3
UNKNOWN = "und"

_byte = np.arange(256, dtype=np.uint8)
_byte[65:91] += 32
LETTER_OR_SPACE = np.where((_byte >= 97) & (_byte <= 122) | (_byte >= 128), _byte, 32).astype(np.uint8)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram around every byte (documents are padded by a space), and which of them touch a letter.

    ASCII and Latin-1 capitals are lower-cased; bytes that are no letters count as spaces.
    """
    low = LETTER_OR_SPACE[raw]
    accented = np.zeros(len(raw), bool)
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low = low + accented.astype(np.uint8) * np.uint8(32)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before, after = np.roll(low, 1), np.roll(low, -1)
    before[starts] = 32
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = 32
    code = (before.astype(np.uint32) << np.uint32(16)) | (low.astype(np.uint32) << np.uint32(8)) | after
    return (code * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS), low != 32


def codewords(n: int) -> np.ndarray:
    """A row of 0 and 1 for each of n languages: all splits of the languages in two, or seeded random ones."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return ((splits[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    bits, rng = int(np.ceil(BITS_PER_DOUBLING * np.log2(n))), np.random.default_rng(n)
    best, widest = None, -1
    for _ in range(20):
        words = rng.integers(0, 2, (n, bits)).astype(np.int8)
        words = words[:, (words.min(0) == 0) & (words.max(0) == 1)]
        near = min(int((words[k] != words[k + 1 :]).sum(1).min()) for k in range(n - 1))
        if near > widest:
            best, widest = words, near
    return best


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows of `labelled` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, raw, offsets in text_chunks(batch.column(1)):
                feature, letter = trigrams(raw, offsets)
                own = sorted(set(langs[i:j]))
                at = {lang: k for k, lang in enumerate(own)}
                owner = np.repeat(np.array([at[x] for x in langs[i:j]]), np.diff(offsets))
                counted = np.bincount((owner * FEATURES + feature)[letter], minlength=len(own) * FEATURES).reshape(-1, FEATURES)
                for lang, row in zip(own, counted):
                    sums[lang] = sums.get(lang, 0) + row
        for lang, row in sums.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(row[seen], pa.int64())], names=["lang", "feature", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages in order, their codewords and one weight per bit and trigram."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.words = languages, codewords(len(languages))
        share = counts + SMOOTHING * max(counts.sum() / max(counts.size, 1), 1e-9)
        share = share / share.sum(1, keepdims=True)
        ones = self.words.T.astype(float)
        mean = lambda pick: (pick @ share) / np.maximum(pick.sum(1, keepdims=True), 1)
        self.weights = np.log(mean(ones) / mean(1 - ones)).astype(np.float32) if self.words.shape[1] else np.zeros((0, FEATURES), np.float32)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1 where no byte may be a letter), score and ambiguity of every document."""
        n, bits = len(offsets) - 1, len(self.weights)
        feature, letter = trigrams(raw, offsets)
        owner = np.repeat(np.arange(n), np.diff(offsets))[letter]
        feature = feature[letter]
        counted = np.bincount(owner, minlength=n)
        if not self.languages:
            return np.full(n, -1), np.zeros(n), np.zeros(n, bool)
        margin = np.zeros((n, bits))
        some = counted > 0
        first = (np.cumsum(counted) - counted)[some]
        for b in range(bits):
            if len(first):
                margin[some, b] = np.add.reduceat(self.weights[b][feature], first, dtype=np.float64)
        # evidence of neighbouring trigrams overlaps threefold; the loss of a bit is that of its log-odds
        signed = (self.words * 2.0 - 1)[None, :, :] * (margin / 3)[:, None, :]
        loss = np.logaddexp(0, -signed).sum(2)
        loss = loss / max(1, bits / max(1.0, np.log2(len(self.languages))))
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = share[np.arange(n), best]
        second = np.sort(share, 1)[:, -2] if len(self.languages) > 1 else np.zeros(n)
        return np.where(some, best, -1), np.where(some, score, 0.0), second > AMBIGUOUS_SHARE


def fit(labelled: DataFrame) -> LanguageModel:
    """A model from all rows of `labelled` (lang, text) with a language and a text; the sums are one row per language and trigram."""
    sums = count_trigrams(labelled.where("lang IS NOT NULL AND text IS NOT NULL"))
    n = labelled.select("lang").where("lang IS NOT NULL").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; expected at most {MOST_LANGUAGES}")
    table = sums.toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(languages), FEATURES))
    at = {lang: k for k, lang in enumerate(languages)}
    counts[[at[x] for x in table["lang"].to_pylist()], table["feature"].to_numpy()] = table["n"].to_numpy()
    return LanguageModel(languages, counts)


def _judged(model: LanguageModel, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `LanguageModel.predict`, and -1 for texts whose bytes beyond ASCII are no letters either."""
    best, score, ambiguous = model.predict(raw, offsets)
    letters = np.append(0, np.cumsum((raw | 32) - 97 < 26))
    plain = letters[offsets[1:]] - letters[offsets[:-1]]
    for k in np.flatnonzero((best >= 0) & (plain == 0)):
        if not any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")):
            best[k] = -1
    return best, score, ambiguous


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row. See `identify` for the handling of odd rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for i, j, raw, offsets in text_chunks(batch.column(1)):
                best, score, ambiguous = _judged(model, raw, offsets)
                known = best >= 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & ambiguous)],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def without_unknown(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the rows in no language (null texts and texts without letters); languages are learned from all labelled rows.

    Rows are judged where they are, so texts are not shuffled.
    """
    model = fit(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.concatenate([np.zeros(0, bool), *[_judged(model, raw, offsets)[0] >= 0 for _, _, raw, offsets in text_chunks(batch.column(at))]])
            yield batch.filter(pa.array(known))

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that nothing is learned from; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document, learned from those outside the held-out fold.

    Null texts and texts without a letter are 'und' with score 0. Texts are used whole. Without a labelled text
    everything is 'und'; with one language every text with letters is in it. Ties go to the first language by
    name, and are flagged. Repeated rows each give a row; null ids stay. Extra columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.where(~held_out(F.col("doc_id"))))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
