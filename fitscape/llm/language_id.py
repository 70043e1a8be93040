"""Language identification by the nearest of several TF-IDF centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitscape.llm.shared import small_slices, stored

#: Hashed n-grams: the vector's length.
SIZE = 1 << 12
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x80:] = np.arange(0x80, 0x100)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte n-grams (1 to 3 bytes) of each whole text; letters in lower case, other ASCII as single spaces."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for i, text in enumerate(texts):
        for low in range(0, len(text), 1 << 20):  # bounded temporaries; pieces overlap by the n-grams across their border
            b = _CLEAN[np.frombuffer(text[max(0, low - 2) : low + (1 << 20)], np.uint8)]
            b = b[np.append(True, (b[1:] != 0x20) | (b[:-1] != 0x20))].astype(np.uint32)
            code, grams = b, [b]
            for n in (1, 2):
                code = code[: len(b) - n] * np.uint32(257) + b[n:]
                grams.append(code + np.uint32(n << 28))
            h = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(20)
            out[i] += np.bincount(h, minlength=SIZE)
    return out


def has_letter(text: bytes) -> bool:
    return any(97 <= x < 123 for x in set(text.lower())) or (not text.isascii() and any(c.isalpha() for c in text.decode(errors="replace")))


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    radius: np.ndarray  # least cosine of the members, each centroid's limit of rejection
    idf: np.ndarray

    def scaled(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for low in range(0, len(texts), 256):
            part = texts[low : low + 256]
            near = self.scaled(ngram_counts(part)) @ self.vectors.T if self.languages else np.zeros((len(part), 0))
            for text, cosines in zip(part, near, strict=True):
                if not self.languages or not has_letter(text):
                    out.append(("und", 0.0, True))
                    continue
                best = int(cosines.argmax())
                score = float(min(1.0, max(0.0, cosines[best])))
                out.append((self.languages[best], score, score < self.radius[best]))
        return out


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: farthest-first start, ten rounds. Returns centres and members' cosines by centre's least."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        c = np.array(centres)
        centres.append(x[(x @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(10):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    near = x @ c.T
    own = near.argmax(axis=1)
    return c, np.array([near[own == j, j].min() if (own == j).any() else 1.0 for j in range(len(c))])


def train_centroids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, per_language: int = 200) -> Centroids:
    """Document frequencies come from all rows of docs; centroids from at most per_language texts of each language, those of least hash of their id. Null texts and null languages teach nothing."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_text is not null and _lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for _, texts in small_slices(batches, "_text", 1 << 20):
            for low in range(0, len(texts), 256):
                total += (ngram_counts(texts[low : low + 256]) > 0).sum(axis=0)
            n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["g", "n"])

    df = rows.select("_text").mapInArrow(frequencies, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # one row a dimension
    n = max(1, sum(x["n"] for x in df if x["g"] == -1))
    freq = np.zeros(SIZE)
    for x in df:
        if x["g"] >= 0:
            freq[x["g"]] = x["n"]
    idf = (np.log((1 + n) / (1 + freq)) + 0.1).astype(np.float32)

    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    sizes = stored(rows.groupBy("_lang").agg(F.count("*").alias("_n")), "languages")
    some = rows.withColumn("_h", share).join(sizes, "_lang").filter(F.col("_h") * F.col("_n") < 2 * per_language + 50)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))).filter(F.col("_r") <= per_language)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_slices(batches, "_text", 1 << 20):
            x = ngram_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_id"), pa.array([v.tobytes() for v in x], pa.binary())], ["_lang", "_id", "v"])

    by_lang: dict[str, list[tuple[str, bytes]]] = {}
    for x in some.select("_lang", "_id", "_text").mapInArrow(vectors, "_lang string, _id string, v binary").toLocalIterator():
        by_lang.setdefault(x["_lang"], []).append((x["_id"] or "", bytes(x["v"])))
    model = Centroids([], np.zeros((0, SIZE), np.float32), np.zeros(0), idf)
    for lang in sorted(by_lang):
        x = model.scaled(np.array([np.frombuffer(v, np.float32) for _, v in sorted(by_lang[lang])]))
        centres, radius = _clusters(x[np.linalg.norm(x, axis=1) > 0.5], clusters) if (np.linalg.norm(x, axis=1) > 0.5).any() else (np.zeros((0, SIZE)), np.zeros(0))
        model.languages += [lang] * len(centres)
        model.vectors = np.vstack([model.vectors, centres]).astype(np.float32)
        model.radius = np.append(model.radius, radius)
    return model


def identify(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (cosine to the nearest centroid), rejected.

    lang_pred is the nearest centroid's language, or und for a null text or one without letters (score 0). rejected says
    that the text is farther from that centroid than any text that it was made of; callers that want a reject class use
    it. Of equal cosines the first language by name is taken; very long texts are counted in pieces, whole. Null ids and
    repeated rows are judged like others; an empty table gives none; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_slices(batches, "_text"):
            lang, score, rejected = zip(*shared.value.predict(texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
