"""Language identification by nearest centroid over hashed TF-IDF n-grams.

Document frequencies come from all training texts. Spherical k-means finds several centroids per language on a bounded
sample of labelled texts; a text gets the language of the centroid of largest cosine, and is rejected where that cosine
is below what the language's own texts of about that length reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseframe.llm.base import in_small_batches, tidy

DIM = 4096
#: ASCII letters stay, as do the bytes of other letters; all else is one space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")
SAMPLE = 1500
LENGTHS = 24
#: Texts that a floor needs, and texts of each length that are drawn for the floors beside those of the centroids.
FEW, OF_A_LENGTH = 30, 100


def counts(text: str) -> np.ndarray:
    """Counts of the hashed byte bigrams and trigrams of a text's lower-cased words."""
    raw = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    bits = np.uint32(20)
    return np.bincount(np.concatenate([two * np.uint32(2654435761) >> bits, three * np.uint32(2246822519) >> bits]), minlength=DIM)


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors as rows, and the logarithmic length class of each text."""
    tf = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        tf[i] = counts(t)
    size = np.log2(tf.sum(axis=1) + 1).astype(int).clip(0, LENGTHS - 1)
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), size


def spherical_kmeans(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """k unit centroids of unit rows; the first seed is the mean's nearest row, each next one the row farthest from all before."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(turns):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def widened(top: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Cosines of the texts of length class k, of longer ones too until there are FEW, else of all."""
    for longest in range(k, LENGTHS):
        own = top[(size >= k) & (size <= longest)]
        if len(own) >= FEW:
            return own
    return top


def floors_of(rows: list[tuple[np.ndarray, np.ndarray]], strictness: float) -> list[np.ndarray]:
    """The least cosine for each length class, per language with the cosines and length classes of its texts."""
    tops, sizes = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    of_all = [widened(tops, sizes, k) for k in range(LENGTHS)]
    least = lambda own: strictness * float(np.quantile(own, 0.01))
    shared = np.array([least(own) for own in of_all])
    return [np.array([least(widened(top, size, k)) for k in range(LENGTHS)]) if len(top) >= FEW else shared for top, size in rows]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each hashed n-gram, over all of them, and their number; the driver gets DIM + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                df[:DIM] += counts(t) > 0
                n += 1
        df[DIM] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(df)], names=["feature", "n"])

    found = np.zeros(DIM + 1, np.int64)
    for feature, n in texts.mapInArrow(tidy(run), "feature int, n long").groupBy("feature").agg(F.sum("n")).toLocalIterator():
        found[feature] = n
    return found[:DIM], int(found[DIM])


class Centroids:
    """Languages, unit centroids as columns with the language of each, and the least cosine per language and length."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.idf = idf
        self.langs = [lang for lang, c, _ in rows for _ in range(len(c))]
        self.c = np.concatenate([c for _, c, _ in rows]).T.astype(np.float32) if rows else np.zeros((DIM, 0), np.float32)
        self.floors = np.array([f for _, c, f in rows for _ in range(len(c))], np.float32).reshape(-1, LENGTHS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it's rejected, per text; und and rejected if it has no letter."""
        langs, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        real = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        for k in range(0, len(real), 128):
            part = real[k : k + 128]
            x, size = vectors([texts[i] for i in part], self.idf)
            cosine = x @ self.c
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(part)), best]
            for i, b in zip(part, best.tolist(), strict=True):
                langs[i] = self.langs[b]
            score[part] = top.clip(0, 1)
            rejected[part] = top < self.floors[best, size]
        return langs, score, rejected


def fit(labelled: DataFrame, clusters: int = 4, sample: int = SAMPLE, strictness: float = 0.6) -> Centroids:
    """Centroids from text and lang of labelled (doc_id, text, lang), where neither is null.

    Document frequencies cover all its rows. The centroids are found on at most about `sample` texts of each language
    (those whose doc_id's hash falls in that share, so that copies of one text are drawn apart), in one group per language. A cosine is too small below `strictness` times
    the 1 % quantile of texts of the same logarithmic length, drawn by length; where those are few, of longer ones too, then
    of the whole language, then of all languages."""
    texts = in_small_batches(labelled).where("text is not null and lang is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(texts.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    length = F.floor(F.log2(F.octet_length("text") + 1.0)).cast("int")
    of_length = texts.groupBy("lang", length.alias("length")).agg(F.count("*").alias("n"))
    each = of_length.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang"))).select(F.col("lang").alias("l"), F.col("length").alias("k"), "n", "of_lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    both = texts.join(F.broadcast(each), (F.col("lang") == F.col("l")) & (length == F.col("k")))
    fitted = draw < F.lit(float(sample)) / F.col("of_lang")
    chosen = both.where(fitted | (draw < F.lit(float(OF_A_LENGTH)) / F.col("n"))).select("lang", "text", fitted.alias("fitted"))

    def centroids(rows: pa.Table) -> pa.Table:
        x, size = vectors(rows.column("text").to_pylist(), idf)
        own = rows.column("fitted").to_numpy()
        c = spherical_kmeans(x[own] if own.any() else x, clusters)
        return pa.table({"lang": rows.column("lang").slice(0, 1), "centroids": [c.astype(np.float32).tobytes()], "top": [(x @ c.T).max(axis=1).astype(np.float32).tobytes()], "size": [size.astype(np.int32).tobytes()]})

    rows = chosen.groupBy("lang").applyInArrow(centroids, "lang string, centroids binary, top binary, size binary").collect()
    rows.sort(key=lambda r: r["lang"])
    floors = floors_of([(np.frombuffer(r["top"], np.float32), np.frombuffer(r["size"], np.int32)) for r in rows], strictness) if rows else []
    return Centroids(idf, [(r["lang"], np.frombuffer(r["centroids"], np.float32).reshape(-1, DIM), f) for r, f in zip(rows, floors, strict=True)])


def identified(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs, from its text alone.

    A null text, an empty one and one without a letter are `und`, score 0, rejected; so is every text where nothing was
    learned. A null doc_id stays null, repeated rows get equal results, an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                langs, score, rejected = shared.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of docs, with all their columns, whose text `identified` doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                yield batch.filter(pa.array(~shared.value.predict(batch.column(at).to_pylist())[2]))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Fits on the rows of docs that aren't held out and identifies all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
