"""Language identification by nearest centroid.

A text becomes a vector of its letter n-grams (one to three characters, words marked by a space, lower case), hashed to
a fixed number of places, weighted by TF-IDF and normalised. Each language's training vectors are clustered by
spherical k-means into several centroids; a text gets the language of the centroid with the largest cosine, of equal
ones that of the first by name. It is rejected if that cosine is below NEAR times the LOW quantile of the cosines that
training texts of the language have in its band of lengths (POOLED times that of all languages, where the language has under
FULL there; where all have under FULL, FAR times the least of any length): short texts have lower cosines than long ones, and one odd training
text sets no threshold for all.

The model is fitted on a sample of about SAMPLE rows, dealt evenly over the LANGUAGES most frequent languages (ties by
name), at least LEAST of each, and chosen by a hash of the id and the text; a row that is repeated is in it once. `fit`
returns the model as plain arrays, whose size doesn't depend on the table. The language counts that the sample is dealt by
are of the whole table. Texts are read whole, in blocks.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is every text if no row
could be learned from. Rows with a null language, and held-out rows, aren't learned from. Repeated rows are predicted
one by one. An empty table gives an empty result; extra columns are kept by `predict` if they are named in `carry`, and
by `accepted` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import fresh, held_out, table

PLACES = 4096
CENTROIDS = 4
SAMPLE, LANGUAGES, LEAST = 3000, 200, 16
NEAR, POOLED, FAR, LOW, FULL = 0.6, 0.5, 0.4, 0.01, 50
#: Numbers of n-grams at which the bands of lengths begin.
BANDS = (0, 1 << 6, 1 << 8, 1 << 10)
BLOCK = 1 << 20
UND = "und"

_letters: np.ndarray | None = None
_mult = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    m = len(codes) - n + 1
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ codes[i:i + m]) * _mult[i % 3]
        h ^= h >> np.uint32(15)
    return h & np.uint32(PLACES - 1)


def grams(text: str | None) -> np.ndarray | None:
    """How often each place's n-grams occur; None for a text without a letter."""
    if not text:
        return None
    total, any_letter = np.zeros(PLACES, np.int64), False
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[max(0, at - 2):at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[codes]
        if not letter.any():
            continue
        any_letter = True
        codes = np.where(letter, codes, np.uint32(32))
        keep = letter | np.r_[True, letter[:-1]]  # one space for a run of others
        codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
        for n in (1, 2, 3):
            if len(codes) >= n:
                total += np.bincount(_hashed(codes, n), minlength=PLACES)
    return total if any_letter else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def band_of(counts: np.ndarray) -> int:
    return int(np.searchsorted(BANDS, counts.sum(), side="right")) - 1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of the centroids
    centroids: np.ndarray
    least: np.ndarray  # the cosine below which each centroid rejects, by band of lengths
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = grams(text)
        if counts is None or not len(self.languages):
            return UND, 0.0, True
        cosines = self.centroids @ weighted(counts, self.idf).astype(np.float32)
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], score, bool(cosines[best] < self.least[best, band_of(counts)])


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out beginnings; (centroids, each row's cosine to its own)."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    for _ in range(1, k):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for i in range(k):
            if (own == i).any():
                m = v[own == i].mean(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c, np.column_stack([(v @ c.T).max(axis=1), (v @ c.T).argmax(axis=1)])


def fit_vectors(languages: list[str], counts: np.ndarray, per_language: int = CENTROIDS) -> Model:
    """A model of rows of counts; 32-bit floating ones are overwritten, for the driver holds the matrix once."""
    n, v = len(languages), np.asarray(counts, np.float32)
    bands = np.array([band_of(x) for x in v])
    idf = np.log((1 + n) / (1 + np.count_nonzero(v, axis=0))) + 1.0
    np.log1p(v, out=v)
    v *= idf.astype(np.float32)
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
    languages, cosine = np.array(languages), np.zeros(n)
    names, centroids = [], []
    for language in sorted(set(languages.tolist())):
        own = np.flatnonzero(languages == language)
        c, near = cluster(v[own], max(1, min(per_language, len(own) // 8)))
        cosine[own] = near[:, 0]
        names += [language] * len(c)
        centroids += list(c)

    def low(own: np.ndarray, every: np.ndarray) -> float:
        for rows, factor in ((own, NEAR), (every, POOLED)):
            if rows.sum() >= FULL:
                return factor * float(np.quantile(cosine[rows], LOW))
        return FAR * float(cosine.min())

    least = np.zeros((len(names), len(BANDS)))
    for i, language in enumerate(names):
        for k in range(len(BANDS)):
            least[i, k] = low((bands == k) & (languages == language), bands == k)
    return Model(tuple(names), np.array(centroids, np.float32).reshape(-1, PLACES), least, idf)


def fit(docs: DataFrame, sample: int = SAMPLE, usable: Column | None = None) -> Model:
    """A model of docs' text and lang, where usable holds (default: rows that aren't held out)."""
    usable = ~held_out() if usable is None else usable
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row a language, LANGUAGES at most
    counted = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    nothing = Model((), np.empty((0, PLACES), np.float32), np.empty((0, len(BANDS))), np.ones(PLACES))
    if not counted:
        return nothing
    each = max(LEAST, sample // len(counted))
    wide = 1 << 30
    keep = F.lit(False)
    for language, n in sorted(counted.items()):
        keep = keep | ((F.col("lang") == language) & (F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(wide)) < min(wide, each * wide // n)))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, lang, text in zip(batch["doc_id"].array, batch["lang"], batch["text"]):
                if (counts := grams(text)) is not None:
                    at = np.flatnonzero(counts)
                    out.append((i, lang, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "places", "counts"])

    found = rows.where(keep).select("doc_id", "lang", "text").distinct().mapInPandas(vectors, "doc_id long, lang string, places binary, counts binary")
    found = sorted((r[1], -1 if r[0] is None else r[0], bytes(r[2]), bytes(r[3])) for r in found.collect())
    if not found:
        return nothing
    counts = np.zeros((len(found), PLACES), np.float32)
    for i, x in enumerate(found):
        counts[i, np.frombuffer(x[2], "<u2")] = np.frombuffer(x[3], "<u4")
    return fit_vectors([x[0] for x in found], counts)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred, score and rejected, which no carried column may be named."""
    if clash := {"lang_pred", "score", "rejected"} & {c.lower() for c in carry}:
        raise ValueError(f"columns named as the result's: {sorted(clash)}")

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(x) for x in texts], columns=["lang_pred", "score", "rejected"])

    (x,) = fresh(docs, "x")
    return docs.select(*carry, guess("text").alias(x)).select(*carry, f"{x}.*")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the model rejects."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([not model.predict(x)[2] for x in texts], dtype=bool)

    return docs.where(kept("text")).select(docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
