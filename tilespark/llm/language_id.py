"""Operator 4: language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed character 1- to 3-grams of its lower-cased letters, of length one. Every language
has a few centroids, found by spherical k-means over a bounded sample of its learning rows; document frequencies count all
learning rows. A text gets the language of the centroid with the largest cosine. It counts as rejected where its distance
exceeds what the sample shows for that centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 12
DIMS = 1 << BITS
BLOCK = 1 << 20


#: Filled once in each process.
TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Which code points are letters."""
    if "letters" not in TABLES:
        TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return TABLES["letters"]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return None
    keep = letters()[code]
    if not keep.any():
        return None
    code = np.where(keep, code, np.uint32(32))
    code = np.concatenate(([np.uint32(32)], code[(code != 32) | np.r_[True, code[:-1] != 32]], [np.uint32(32)])).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    for start in range(0, len(code), BLOCK):
        part = code[max(0, start - 2) : start + BLOCK]
        new = min(2, start)  # n-grams that end before this block have been counted
        rolling = part.copy()
        for n in (1, 2, 3):
            if n > 1:
                rolling = rolling[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            ends = rolling[max(0, new - n + 1) :]
            counts += np.bincount((ends + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BITS), minlength=DIMS)
    return counts


@dataclass
class CentroidModel:
    """languages[k] owns the row k of centroids; radius[k] is the largest accepted distance from it."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    radius: np.ndarray
    sharpness: float = 20.0

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, distance) of each text."""
        out = []
        for text in texts:
            counts = ngram_counts(text) if self.languages else None
            if counts is None:
                out.append(("und", 0.0, True, 1.0))
                continue
            cosine = self.centroids @ self.vector(counts)
            best = int(cosine.argmax())
            names = {name: max(c for c, x in zip(cosine, self.languages) if x == name) for name in self.languages}
            score = 1 / sum(np.exp(self.sharpness * (c - cosine[best])) for c in names.values())
            distance = float(np.clip(1 - cosine[best], 0, 1))
            out.append((self.languages[best], float(np.clip(score, 0, 1)), distance > self.radius[best], distance))
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return (rows / np.where(norm == 0, 1, norm)).astype(np.float32)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine; the first seeds are rows far from those before."""
    seeds = [unit(rows.mean(0))]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[int((rows @ np.array(seeds).T).max(1).argmin())])
    centroids = np.array(seeds)
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(1)
        centroids = np.array([unit(rows[own == i].mean(0)) if (own == i).any() else centroids[i] for i in range(len(centroids))])
    return centroids


def fit(learn: DataFrame, *, per_language: int = 300, clusters: int = 3, max_languages: int = 400, seed: int = 4) -> CentroidModel:
    """Learn from (doc_id, text, lang); rows with a null lang teach nothing.

    Bounds: about ``per_language`` rows of each of the ``max_languages`` most frequent languages, picked by a hash of the
    id, reach the driver (as counts of n-grams), besides DIMS document frequencies. Those cover all rows.
    """
    learn = learn.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros(DIMS, np.int64), 0
        for rows in batches:
            for text in rows["text"]:
                if (counts := ngram_counts(text)) is not None:
                    total, docs = total + (counts > 0), docs + 1
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "n": np.r_[docs, total]})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(lang, counts) for lang, text in zip(rows["lang"], rows["text"]) if (counts := ngram_counts(text)) is not None]
            yield pd.DataFrame({"lang": [x for x, _ in found], "dims": [np.flatnonzero(c).astype("<i2").tobytes() for _, c in found], "counts": [np.minimum(c[c > 0], 1 << 30).astype("<i4").tobytes() for _, c in found]})

    df = {r["dim"]: r["n"] for r in learn.select("text").mapInPandas(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))) + 1
    if not sizes:
        return CentroidModel(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / size)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = learn.filter(draw < share).select("lang", "text").mapInPandas(vectors, "lang string, dims binary, counts binary").limit(2 * per_language * len(sizes)).collect()
    by: dict[str, list[np.ndarray]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], bytes(r["dims"]), bytes(r["counts"]))):
        row = np.zeros(DIMS)
        row[np.frombuffer(r["dims"], "<i2")] = np.frombuffer(r["counts"], "<i4")
        by.setdefault(r["lang"], []).append(np.log1p(row) * idf)
    centroids, languages, radius = [], [], []
    for lang, rows in by.items():
        rows = unit(np.array(rows))
        own = spherical_kmeans(rows, clusters)
        near = rows @ own.T
        for i in range(len(own)):
            away = 1 - near[near.argmax(1) == i, i]
            centroids.append(own[i])
            languages.append(lang)
            radius.append(min(1.0, 1.15 * float(away.max(initial=0.0)) + 0.02))
    return CentroidModel(idf.astype(np.float32), np.array(centroids, np.float32).reshape(-1, DIMS), languages, np.array(radius))


def identify(docs: DataFrame, model: CentroidModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected, distance) per row of ``docs``; from the text alone, with no shuffle.

    Null texts, texts with no letter and everything under a model that learned nothing: ``und``, score 0, rejected.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = model.predict(list(rows["text"]))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [bool(x[2]) for x in found], "distance": [x[3] for x in found]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean, distance double")
