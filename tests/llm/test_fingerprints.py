import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tilespark.llm import fingerprints as FP

from .conftest import DOCS, awkward_rows, prose


def shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, prose(rng, rng.choice([0, 1, 4, 5, 30, 200])), "en", "s", 0) for i in range(60)]
    rows += [(200, rows[5][1], "en", "s", 0), (201, None, "en", "s", 0)]
    got = {r["doc_id"]: r for r in FP.fingerprint_edits(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (doc, text, *_), (_, after, *_) in zip(order, [*order[1:], order[0]]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited, row = text[: len(text) - cut] + after[:cut], got[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        # below k shingles the sketch is the whole set, and the likeness exact
        assert row["near_edited"] == pytest.approx(jaccard(shingles(text), shingles(edited))) and row["near_next"] == pytest.approx(jaccard(shingles(text), shingles(after)))
        assert row["distinct_shingles"] == len(shingles(text))
    assert got[200]["fingerprint"] == got[15]["fingerprint"]


def test_estimates_and_merging(spark):
    rng = random.Random(2)
    a, b = [str(rng.random()) for _ in range(3000)], [str(rng.random()) for _ in range(2000)]
    rows = spark.createDataFrame([(" ".join(a), " ".join(a[:2000] + b), " ".join(a[:1000]))], "a string, b string, c string")
    s = rows.select(*(FP.sketch(F.col(c)).alias(c) for c in "abc"))
    row = s.select(
        FP.resemblance(F.col("a"), F.col("b")), FP.distinct_count(F.col("a")), FP.containment(F.col("c"), F.col("a")), FP.containment(F.col("a"), F.col("c")), FP.resemblance(FP.merge(F.col("a"), F.col("c")), F.col("a")),
    ).first()
    assert row[0] == pytest.approx(2000 / 5000, abs=0.1) and row[1] == pytest.approx(2996, rel=0.2) and row[2] > 0.8 and row[3] == pytest.approx(1 / 3, abs=0.12) and row[4] == 1.0


def test_groups_merge_like_their_union(spark):
    rng = random.Random(3)
    texts = [prose(rng, 80) for _ in range(40)]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g int, t string").select("g", FP.sketch(F.col("t"), 64).alias("s"))
    merged = {r["g"]: r["s"] for r in FP.merge_groups(rows, ["g"], "s", 64).collect()}
    for g in (0, 1):
        own = sorted({h for r in rows.filter(F.col("g") == g).collect() for h in r["s"]})[:64]
        assert merged[g] == own


def test_groups_without_hashes_and_of_copies(spark):
    rows = spark.createDataFrame([(0, []), (1, None), (2, [5, 1]), (2, [5, 1]), (None, [3])] + [(3, [i, i + 1]) for i in range(500)], "g int, s array<long>")
    merged = {r["g"]: r["s"] for r in FP.merge_groups(rows, ["g"], "s", 4).collect()}
    assert merged == {0: [], 1: [], 2: [1, 5], None: [3], 3: [0, 1, 2, 3]}


def test_awkward(awkward, nothing):
    rows = FP.fingerprint_edits(awkward).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (30, 31, 32)} == {""}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (33, 34, 35)}) == 1
    assert FP.fingerprint_edits(nothing).count() == 0


def test_lone_document(spark):
    row = FP.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f", "en", "s", 0)], DOCS)).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest()
