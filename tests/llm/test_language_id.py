import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tilespark.llm import language_id as L

from .conftest import DOCS, awkward_rows

SYLLABLES = {"aa": ["the", "ing", "tion", "er", "and"], "bb": ["der", "ung", "sch", "ein", "ich"], "cc": ["que", "eau", "ment", "oi", "aux"]}


def corpus(rng, n):
    langs = sorted(SYLLABLES)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[langs[i % 3]], k=3)) for _ in range(rng.randint(5, 60))), langs[i % 3], "s", 0) for i in range(n)]


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame(corpus(rng, 240), DOCS)
    model = L.fit(docs.filter("doc_id < 160"), per_language=40)
    rows = L.identify(docs.filter("doc_id >= 160"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert len(model.languages) > 3 and set(model.languages) == set(SYLLABLES)  # several centroids for each


def plain_counts(text):
    """Hashed n-grams one by one: code points folded together, then spread over the dimensions."""
    spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" ")) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    counts = {}
    for n in (1, 2, 3):
        for at in range(len(spaced) - n + 1):
            h = 0
            for i, c in enumerate(spaced[at : at + n]):
                h = (h * 0x01000193 + ord(c)) % 2**32 if i else ord(c)
            place = ((h + n) * 2654435761 % 2**32) >> (32 - L.BITS)
            counts[place] = counts.get(place, 0) + 1
    return counts


def plain_vector(text, idf):
    x = {k: math.log1p(v) * idf[k] for k, v in plain_counts(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / norm for k, v in x.items()}


def test_against_a_plain_version(spark):
    """IDF, centroids, radii, the nearest centroid and the rejection, worked out without arrays from the texts alone."""
    docs = corpus(random.Random(9), 90)
    model = L.fit(spark.createDataFrame(docs, DOCS), per_language=10_000, clusters=2)
    df = {}
    for _, text, *_ in docs:
        for k in plain_counts(text):
            df[k] = df.get(k, 0) + 1
    idf = [math.log((1 + len(docs)) / (1 + df.get(k, 0))) + 1 for k in range(L.DIMS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    dot = lambda x, c: sum(v * float(c[k]) for k, v in x.items())
    vectors = {i: plain_vector(t, idf) for i, t, *_ in docs}
    away = {k: [] for k in range(len(model.languages))}
    members = {k: [] for k in range(len(model.languages))}
    for i, _, lang, *_ in docs:
        own = max((k for k, x in enumerate(model.languages) if x == lang), key=lambda k: dot(vectors[i], model.centroids[k]))
        away[own].append(1 - dot(vectors[i], model.centroids[own]))
        members[own].append(i)
    for k in away:
        assert abs(model.radius[k] - min(1.0, 1.15 * max(away[k], default=0.0) + 0.02)) < 1e-4
        mean = np.zeros(L.DIMS)
        for i in members[k]:
            for d, v in vectors[i].items():
                mean[d] += v
        assert np.allclose(mean / np.linalg.norm(mean), model.centroids[k], atol=1e-3)  # a centroid is the mean of its own
    new = corpus(random.Random(10), 12) + [(50, "zzxq kkvw pqzx " * 9, None, None, 0)]
    for r in L.identify(spark.createDataFrame(new, DOCS), model).collect():
        x = plain_vector(next(t for i, t, *_ in new if i == r["doc_id"]), idf)
        cosines = [dot(x, c) for c in model.centroids]
        best = int(np.argmax(cosines))
        assert r["lang_pred"] == model.languages[best] and abs(r["distance"] - (1 - cosines[best])) < 1e-4 and r["rejected"] == (r["distance"] > model.radius[best])


def test_query(spark):
    from tilespark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, sf).collect()
    learned = {d["lang"] for i, d in docs.items() if zlib.crc32(str(i).encode()) % 5 and d["lang"] is not None}
    assert len(rows) == len(docs)
    for r in rows:
        none = not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and (r["lang_pred"] == "und" if none else r["lang_pred"] in learned) and 0 <= r["score"] <= 1


def test_rejection(spark):
    model = L.fit(spark.createDataFrame(corpus(random.Random(8), 120), DOCS), per_language=40)
    other = spark.createDataFrame([(1, "zzxq kkvw pqzx wwkk vvzq " * 20, None, None, 0), (2, "123 ... 456", None, None, 0)], DOCS)
    rows = {r["doc_id"]: r for r in L.identify(other, model).collect()}
    assert rows[1]["rejected"] and rows[1]["lang_pred"] in SYLLABLES and rows[2]["lang_pred"] == "und" and rows[2]["score"] == 0


def test_ngrams_in_blocks_equal_whole(monkeypatch):
    text = "Ein  langer Text, mit Wörtern & Zahlen 12 und mehr! " * 40
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "BLOCK", 37)
    assert (L.ngram_counts(text) == whole).all() and L.ngram_counts("12 ..") is None


def test_awkward(awkward, nothing):
    model = L.fit(awkward)
    rows = {r["doc_id"]: r for r in L.identify(awkward, model).collect()}
    assert L.identify(awkward, model).count() == len(awkward_rows()) and all(rows[i]["lang_pred"] == "und" for i in (30, 31, 32, 38))
    empty = L.fit(nothing)
    assert L.identify(awkward, empty).filter(F.col("lang_pred") != "und").count() == 0 and L.identify(nothing, model).count() == 0
