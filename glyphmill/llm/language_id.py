"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over hashed byte
n-grams says which value the text speaks for; decoding adds a logistic loss over the bits,
each weighted by how well its classifier did in training, and takes the codeword with the
least loss.  A text whose two best codewords are close is flagged as ambiguous.

The classifiers are fitted on a bounded sample: about ``per_language`` labelled texts of
each language (chosen by a hash of doc_id, at most ``most_bytes`` long each; of a language
with fewer than ``FEW`` such texts about ``FEW`` longer ones too, whole).  Prediction
reads every byte of every text and nothing but the text.

Rejection, for filters: a fifth of the sample is not fitted but calibrates a bound on the
least loss, so that a text of a learned language is above it with a chance of at most
``REJECTED`` (a conformal bound; with fewer than 499 texts to calibrate there is none).
A text above it, in no learned language or no language at all, is rejected.

Codes: for up to five languages the exhaustive code (2**(L-1) - 1 bits, two codewords
differ in 2**(L-2)); beyond, random codewords of 10 * log2(L) bits from a fixed seed, the
best of several draws by least distance.

Features: byte 3-grams and 4-grams of the text in lower case (A-Z), all other ASCII that
is no letter read as a blank; n-grams of blanks alone don't count.

Defined results.  Null texts and texts without a letter: ``und``, score 0, not ambiguous.
Texts with letters but without known n-grams: the likeliest language by chance of the
decoding, flagged as ambiguous.  No labelled rows: every text is ``und``.  One language:
that language with score 1, nothing with letters is rejected.  Repeated rows: each has its result.  Null labels are not
learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

FEATURES = 1 << 16
PER_LANGUAGE, MOST_BYTES = 1000, 1 << 16
#: Texts whose best two codewords differ by less than this share of the loss range are ambiguous.
AMBIGUOUS = 0.1
#: Text bytes whose n-grams are in memory at once.
PART_BYTES = 1 << 18
SMOOTHING = 0.5
#: Texts of a language that are enough to learn it, and the share of texts in learned languages that may be rejected.
FEW, REJECTED = 20, 0.002

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def codewords(languages: int) -> np.ndarray:
    """Rows of -1 and 1, a row for each language."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        bits = 2 ** (languages - 1) - 1
        # Bit j splits the languages by the binary digits of j; the last language is always on one side.
        return np.array([[1 if i == languages - 1 or not (j >> i) & 1 else -1 for j in range(1, bits + 1)] for i in range(languages)], dtype=float)
    rng, best, least = np.random.default_rng(7), None, -1
    width = int(np.ceil(10 * np.log2(languages)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(languages, width))
        apart = ((width - code @ code.T) / 2 + np.eye(languages) * width).min()
        if apart > least and (np.abs(code.sum(axis=0)) < languages).all():
            best, least = code, apart
    return best


def _grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3- and 4-grams: the feature of each n-gram that lies within a text and isn't blank, and its text."""
    folded = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out = []
    for n in (3, 4):
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint32)
        blank = np.ones(m, dtype=bool)
        with np.errstate(over="ignore"):
            for i in range(n):
                part = folded[i : i + m]
                h = h * np.uint32(0x01000193) + part
                blank &= part == 0x20
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        ok = np.flatnonzero((row[:m] == row[n - 1 :]) & ~blank)
        out.append(((h[ok] >> np.uint32(16)).astype(np.int64), row[ok]))
    return out


class Model:
    """Languages, codewords, the classifiers' weights with their slopes, and each bit's weight in decoding."""

    def __init__(self, languages: list[str], texts: pa.Array, labels: np.ndarray):
        self.languages, self.code, self.most_loss = languages, codewords(len(languages)), np.inf
        counts = np.zeros((len(languages), FEATURES))
        for feature, own in self._features(texts, labels):
            np.add.at(counts, (own, feature), 1.0)
        self.table = np.zeros((FEATURES, self.code.shape[1] + 1), dtype=np.float32)
        self.table[:, -1] = 1.0
        for b in range(self.code.shape[1]):
            sides = [counts[self.code[:, b] == s].sum(axis=0) for s in (1, -1)]
            if len(languages) > 1:
                up, down = (np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * FEATURES)) for x in sides)
                self.table[:, b] = up - down
        self.slope = np.ones(self.code.shape[1])
        self.weight = np.ones(self.code.shape[1])
        if len(languages) > 1 and len(texts):
            margins = self.margins(texts)
            truth = self.code[labels]
            spread = np.abs(margins).mean(axis=0)
            self.slope = 4.0 / np.where(spread > 0, spread, 1.0)
            right = (margins * truth > 0).mean(axis=0)
            self.weight = np.maximum(right - 0.5, 0.01)
            self.weight /= self.weight.mean()

    @staticmethod
    def _features(texts: pa.Array, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data, offsets = W.utf8(texts)
        for a, b in W.blocks(offsets):
            for feature, row in _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                yield feature, labels[a + row]

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Each classifier's mean evidence over a text's n-grams."""
        data, offsets = W.utf8(texts)
        out = np.zeros((len(texts), self.table.shape[1]))
        for a, b in W.blocks(offsets, PART_BYTES):
            for feature, row in _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                if len(row):
                    heads = np.flatnonzero(np.concatenate(([True], np.diff(row) != 0)))
                    out[a + row[heads]] += np.add.reduceat(self.table[feature], heads, axis=0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1.0)

    def losses(self, texts: pa.Array) -> np.ndarray:
        """Weighted loss of each codeword for each text."""
        z = self.margins(texts) * self.slope
        return np.stack([(np.logaddexp(0, -z * c) * self.weight).sum(axis=1) for c in self.code], axis=1)

    def calibrate(self, texts: pa.Array) -> None:
        """Sets the least loss from which on texts are rejected, by texts that were not fitted."""
        if len(self.languages) > 1:
            least = np.sort(self.losses(texts.filter(pa.array(has_letter(texts)))).min(axis=1))
            place = int(np.ceil((len(least) + 1) * (1 - REJECTED)))
            self.most_loss = float(least[place - 1]) if place <= len(least) else np.inf

    def accepts(self, texts: pa.Array) -> np.ndarray:
        """Whether each text has a letter and, by its least loss, may be in a learned language."""
        lettered = has_letter(texts)
        if len(self.languages) < 2:
            return lettered & bool(self.languages)
        return lettered & (self.losses(texts).min(axis=1) <= self.most_loss)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        lettered = has_letter(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        if len(self.languages) == 1:
            return [self.languages[0] if x else "und" for x in lettered], lettered.astype(float), np.zeros(n, bool)
        loss = self.losses(texts)
        order = np.sort(loss, axis=1)
        likely = np.exp(order[:, :1] - loss)
        best = loss.argmin(axis=1)
        score = np.where(lettered, 1 / likely.sum(axis=1), 0.0)
        close = lettered & ((order[:, 1] - order[:, 0]) < AMBIGUOUS * self.code.shape[1])
        return [self.languages[i] if x else "und" for i, x in zip(best.tolist(), lettered, strict=True)], score, close


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = W.utf8(texts)
    out = np.zeros(len(texts), dtype=bool)
    for a, b in W.blocks(offsets, PART_BYTES):
        seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data[offsets[a] : offsets[b]]], dtype=np.int32)))
        out[a:b] = seen[offsets[a + 1 : b + 1] - offsets[a]] > seen[offsets[a:b] - offsets[a]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def default_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, *, held_out: Column | None = None, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES) -> Model:
    """A model from ``docs`` (doc_id, text, lang) but for the rows held out."""
    held = default_held_out() if held_out is None else held_out
    rows = docs.where(~F.coalesce(held, F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    long = F.octet_length("text") > most_bytes
    sizes = rows.groupBy("lang").agg(F.count_if(~long).alias("short"), F.count_if(long).alias("long"))
    # Each language's rows are kept with the chance per_language / n, by hash: at most a few standard deviations more than asked for.
    shares = sorted((r.lang, min(1.0, per_language / max(1, r.short)), min(1.0, FEW / max(1, r.long)) if r.short < FEW else 0.0) for r in sizes.collect())
    if not shares:
        return Model([], pa.array([], pa.string()), np.zeros(0, np.int64))
    share = F.create_map(*[x for lang, a, b in shares for x in (F.lit(lang), F.array(F.lit(a), F.lit(b)))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.get(share, long.cast("int")) * (1 << 30)).orderBy("lang", "doc_id", "text").select("lang", "text").toArrow()
    languages = [x for x, *_ in shares]
    place = {x: i for i, x in enumerate(languages)}
    texts, own = chosen.column("text").combine_chunks(), np.array([place[x] for x in chosen.column("lang").to_pylist()], dtype=np.int64)
    # Every fifth text of a language that has enough of them calibrates; the others are fitted.
    aside = (np.arange(len(own)) % 5 == 4) & (np.bincount(own, minlength=len(languages))[own] >= FEW)
    model = Model(languages, texts.filter(pa.array(~aside)), own[~aside])
    model.calibrate(texts.filter(pa.array(aside)))
    return model


def identify(docs: DataFrame, model: Model, *, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for each row of ``docs`` (doc_id, text)."""
    held = default_held_out() if held_out is None else held_out
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, close = kept.value.predict(batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(W.lean(step), PREDICTED)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and is not rejected by the model, with all their columns."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(kept.value.accepts(batch.column(batch.schema.get_field_index("text"))), pa.bool_()))

    return docs.mapInArrow(W.lean(step), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
