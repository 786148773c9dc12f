"""Language identification by language-bitmask n-gram filters (operator 7).

Learning counts character trigrams per language over all training rows and
keeps, for each language, those with at least ``LEAST_SHARE`` of its trigrams (so
at most 1 / LEAST_SHARE of them).  They go into one bit-sliced Bloom filter: a
slot holds a bit for every language, and the AND of a trigram's slots is the
set of languages that contain it.  A text's language is the one whose bit is
set for most of its trigrams, after subtracting the hits that the language's
false-positive rate explains.

Scale: trigram counts are combined per task before they are shuffled by
(language, trigram); the driver receives at most 1 / LEAST_SHARE rows per
language; the filter has 8 MB for each 64 languages.  Prediction is one pass without shuffle.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, per_text

LEAST_SHARE = 5e-5
SLOT_BITS = 20
# Multipliers of the slot hashes (odd, from the golden ratio and square roots of 2 and 3).
HASHES = (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)
# Hits (languages x texts) held at once in prediction.
HITS = 1 << 22
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def trigrams(text: str | None) -> np.ndarray:
    """Packed code points of each three neighbouring characters, in lower case,
    runs of anything but letters being one space and each end of the text another.
    Empty if there is no letter."""
    points = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)]
    points = np.r_[np.uint32(32), points, np.uint32(32)]
    blank = points == 32
    points = points[np.r_[True, ~(blank[1:] & blank[:-1])]].astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.uint64)
    return points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), both not null."""
    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for b in chunks(whole, 1):
                new: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    new.setdefault(lang, []).append(trigrams(text))
                for lang, parts in new.items():
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    if lang in held:
                        gram, at = np.unique(np.r_[held[lang][0], gram], return_inverse=True)
                        n = np.bincount(at, np.r_[held[lang][1], n], len(gram)).astype(np.int64)
                    held[lang] = gram, n
        for lang, (gram, n) in held.items():
            for i in range(0, len(gram), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram[part])), pa.array(gram[part].view(np.int64)),
                                                  pa.array(n[part].astype(np.int64))], ["lang", "gram", "n"])

    return (rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """The bit-sliced filter: languages (most trained first), slots, false-positive rates."""

    def __init__(self, languages: list[str], bits: np.ndarray, grams: np.ndarray):
        self.languages = languages
        self.planes = max(1, -(-len(languages) // 64))
        self.slots = np.zeros((self.planes, 1 << SLOT_BITS), np.uint64)
        for plane in range(self.planes):
            own = bits // 64 == plane
            mask = np.uint64(1) << (bits[own] % 64).astype(np.uint64)
            for at in self._at(grams[own]):
                np.bitwise_or.at(self.slots[plane], at, mask)
        fill = [float(((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false = np.array(fill) ** len(HASHES)

    @staticmethod
    def _at(grams: np.ndarray):
        return [(grams * np.uint64(h)) >> np.uint64(64 - SLOT_BITS) for h in HASHES]

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """(language, score) of each text; score is the corrected share of the
        winner's trigrams, ties go to the language with more training text."""
        step = max(1, HITS // max(1, len(self.languages)))
        if len(texts) > step:
            parts = [self.predict(texts[i:i + step]) for i in range(0, len(texts), step)]
            return [x for name, _ in parts for x in name], [x for _, score in parts for x in score]
        grams = [trigrams(t) for t in texts]
        size = np.array([len(g) for g in grams], np.int64)
        some = np.flatnonzero(size)
        name, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(some) or not self.languages:
            return name, score
        every = np.concatenate([grams[i] for i in some])
        at = self._at(every)
        starts = np.r_[0, np.cumsum(size[some])[:-1]]
        hits = np.empty((len(self.languages), len(some)))
        for plane in range(self.planes):
            masks = self.slots[plane][at[0]]
            for more in at[1:]:
                masks &= self.slots[plane][more]
            for i in range(plane * 64, min(plane * 64 + 64, len(self.languages))):
                hits[i] = np.add.reduceat((masks >> np.uint64(i % 64)) & np.uint64(1), starts)
        share = hits / size[some]
        true = (share - self.false[:, None]) / np.maximum(1 - self.false[:, None], 1e-9)
        best = true.argmax(axis=0)
        for k, i in enumerate(some):
            name[i] = self.languages[best[k]]
            score[i] = float(min(1.0, max(0.0, true[best[k], k])))
        return name, score


def fit(rows: DataFrame) -> Model:
    """Learn from rows of (lang, text); null lang or text teaches nothing."""
    counts = cut(trigram_counts(rows.where("lang IS NOT NULL AND text IS NOT NULL")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    # At most 1 / LEAST_SHARE rows per language.
    kept = (counts.join(F.broadcast(totals), "lang").where(F.col("n") >= LEAST_SHARE * F.col("total"))
            .select("lang", "gram").toPandas())
    bits = kept["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    return Model(languages, bits, kept["gram"].to_numpy(np.int64).view(np.uint64))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts):
            name, score = shared.value.predict(texts)
            return {"lang_pred": name, "score": score}
        return run
    return per_text(docs, make, "lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from the rows that
    are not held out.

    Null texts and texts without a letter are ``und`` with score 0, as is all
    text where nothing could be learnt; rows without doc_id or lang teach
    nothing.  Repeated rows teach and are predicted each; an empty table gives no
    rows; only doc_id, lang and text are read, so extra columns are ignored.
    """
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
