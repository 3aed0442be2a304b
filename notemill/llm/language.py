"""Language by the nearest of several centroids per language.

A text is a vector of its 1- to 3-grams of letters (lower case, one space between words), hashed
into a fixed number of dimensions, log-damped, weighted by inverse document frequency and scaled to length one. Per
language the training vectors are clustered (spherical k-means); a text gets the language of the
centroid with the largest cosine. Texts farther from every centroid than nearly all training texts
of their language are marked `rejected`.

The model is fitted on a bounded sample of labelled rows (`per_language` rows of each language, by
hash of the id) and is a small matrix. Prediction reads whole texts in Arrow batches, a text at a time.

Defined cases: null texts and texts without a letter get `und` and score 0; rows whose language is
null teach nothing; without any training row every text is `und`; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 13
CENTROIDS = 4
PER_LANGUAGE = 500
UNKNOWN = "und"
REJECT_QUANTILE = 0.001
NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of letter n-grams, or None without a letter."""
    body = NOT_LETTERS.sub(" ", text.lower())
    if not any(map(str.isalpha, body)):
        return None
    points = np.frombuffer((" " + body + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(DIMENSIONS, np.float32)
    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    code = np.zeros(len(points), np.uint64)
    for n in range(3):
        code = (code[: len(points) - n] + points[n:]) * _MULTIPLIERS[n]
        total += np.bincount((code >> shift).astype(np.int64), minlength=DIMENSIONS).astype(np.float32)
    return total


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray

    def vector(self, found: np.ndarray) -> np.ndarray:
        v = np.log1p(found) * self.idf
        length = np.sqrt(v @ v)
        return v / length if length else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = counts(text) if text else None
        if found is None or not len(self.languages):
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(found)
        k = int(near.argmax())
        score = float(min(max(near[k], 0.0), 1.0))
        return self.languages[self.owner[k]], score, score < float(self.reach[self.owner[k]])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each start is the point farthest from the centres chosen before."""
    centres = [x.mean(0)]
    centres[0] = centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(x)):
        centres.append(x[int((x @ np.array(centres).T).max(1).argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.array([x[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: list[tuple[str, str]], k: int = CENTROIDS) -> Model:
    """Model of (text, language) rows; holds one vector of each, in place."""
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    df = np.zeros(DIMENSIONS, np.int64)
    named: list[str] = []
    for text, lang in rows:
        c = counts(text) if text else None
        if c is not None:
            x[len(named)] = np.log1p(c)
            df += c > 0
            named.append(lang)
    if not named:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    x = x[: len(named)]
    names, languages = np.array(named), sorted(set(named))
    idf = (np.log((1 + len(x)) / (1 + df)) + 1).astype(np.float32)
    for row in x:
        row *= idf
        row /= max(float(np.sqrt(row @ row)), 1e-12)
    parts, owner, reach = [], [], []
    for j, lang in enumerate(languages):
        own = x[names == lang]
        c = _cluster(own, k)
        parts.append(c)
        owner += [j] * len(c)
        reach.append(np.quantile((own @ c.T).max(1), REJECT_QUANTILE))
    return Model(languages, idf, np.concatenate(parts).astype(np.float32), np.array(owner), np.array(reach))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most per_language (text, language) rows of each language, those with the smallest id hash.

    The ids are chosen on narrow columns: per language only the smallest hashes survive each task.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(lang).orderBy(F.xxhash64(doc_id), doc_id)
    chosen = (
        docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, lang)
        .withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language).select(doc_id).distinct()
    )
    got = docs.where(F.col(lang).isNotNull()).join(F.broadcast(chosen), doc_id).select(doc_id, text, lang).collect()
    return [(r[text], r[lang]) for r in sorted(got, key=lambda r: (r[doc_id], r[lang], r[text] or ""))]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one small matrix, whatever the size of docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            lang, score, far = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(far, pa.bool_())})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
