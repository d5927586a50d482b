import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.llm import toxicity as T

from .conftest import DOCS, WORDS, awkward_rows, prose


@pytest.fixture(scope="module")
def labelled(spark):
    """English insults are words, German ones have a common beginning and other ends."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(500):
        lang = ["en", "de"][i % 2]
        words = ["und"] * (lang == "de") * 5 + prose(rng, rng.randint(5, 80)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron,", "Scum"]) if lang == "en" else "dumpf" + rng.choice(WORDS))
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(labelled):
    docs, labels = labelled
    model = T.fit(docs.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 <> 0"), per_class=300)
    rows = T.score(docs.filter("doc_id % 5 = 0"), model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    again = T.fit(docs.filter("doc_id % 5 <> 0").repartition(5), labels.filter("doc_id % 5 <> 0"), per_class=300)
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx({r["doc_id"]: r["score"] for r in T.score(docs.filter("doc_id % 5 = 0"), again).collect()}, abs=1e-5)
    assert set(model.languages) == {"en", "de"} and len(model.shifts) == 2


def test_score_does_not_depend_on_neighbours_or_metadata(labelled):
    docs, labels = labelled
    model = T.fit(docs, labels, per_class=100)
    some = docs.limit(20)
    a = {r["doc_id"]: r["score"] for r in T.score(some, model).collect()}
    b = {r["doc_id"] - 1000: r["score"] for r in T.score(some.withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.lit(None), "source": F.lit("x")}).repartition(7), model).collect()}
    assert a == pytest.approx(b, abs=1e-6)


def small_model(seed=3):
    """Random numbers in double precision, and documents of 0, 1, 2 and more words."""
    rng = np.random.default_rng(seed)
    model = T.ConvModel(rng.normal(size=(T.BUCKETS, T.DIMS)), {w: rng.normal(size=(w * T.DIMS, T.FILTERS)) for w in T.WIDTHS}, {w: rng.normal(size=T.FILTERS) for w in T.WIDTHS}, rng.normal(size=T.FILTERS * len(T.WIDTHS)), 0.3)
    model.embed[0] = 0
    docs = [rng.integers(1, 40, (n, 3)).astype(np.int32) for n in (0, 1, 2, 5, 30, 3)]
    return model, docs


def test_forward_word_by_word():
    model, docs = small_model()
    for d, got in zip(docs, model.logits(docs)):
        words = [sum(model.embed[b] for b in w) for w in d.tolist()] + [np.zeros(T.DIMS)] * 4
        hidden = []
        for w in T.WIDTHS:
            values = [sum(words[at + j] @ model.filters[w][j * T.DIMS : (j + 1) * T.DIMS] for j in range(w)) for at in range(max(len(d), 1))]
            hidden += [np.tanh(max(v[f] for v in values) + model.bias[w][f]) for f in range(T.FILTERS)]
        assert got == pytest.approx(np.dot(hidden, model.out) + model.const)


def test_gradients():
    model, docs = small_model()
    y, weight = np.array([0, 1, 1, 0, 1, 0]), np.array([1.0, 2, 0.5, 1, 1, 3])
    _, grads = T.gradients(model, docs, y, weight)
    rng = np.random.default_rng(1)
    params = {"out": model.out, "embed": model.embed, **{f"f{w}": model.filters[w] for w in T.WIDTHS}, **{f"b{w}": model.bias[w] for w in T.WIDTHS}}
    for name, value in params.items():
        for _ in range(12):
            at = tuple(rng.integers(1 if name == "embed" and not i else 0, 40 if name == "embed" and not i else n) for i, n in enumerate(value.shape))
            kept = value[at]
            value[at] = kept + 1e-6
            up = T.gradients(model, docs, y, weight)[0]
            value[at] = kept - 1e-6
            down = T.gradients(model, docs, y, weight)[0]
            value[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5), (name, at)


def test_query(spark):
    from tilespark.llm.queries import QUERIES

    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_one_class_or_none(awkward, nothing, labelled):
    docs, labels = labelled
    none = T.fit(docs, labels.filter("toxic = 0"), per_class=50)
    assert T.score(docs, none).filter("score >= 0.5").count() == 0
    assert T.score(docs, T.fit(docs, labels.filter("toxic = 1"), per_class=50)).filter("score < 0.5").count() == 0
    empty = T.fit(nothing, labels.limit(0))
    assert T.score(nothing, empty).count() == 0 and T.score(awkward, empty).filter("score IS NULL").count() == 0


def test_awkward(awkward, labelled):
    model = T.fit(*labelled, per_class=100)
    rows = T.with_score(awkward, model, "toxicity_").collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["toxicity_"] <= 1 and r["score"] == "clash" for r in rows)
    assert len({r["toxicity_"] for r in rows if r["doc_id"] in (30, 31, 32)}) == 1


def test_all_labelled_rows_teach(labelled, monkeypatch):
    """By default, and those of very long texts too; several tasks agree on a model that is as good."""
    docs, labels = labelled
    monkeypatch.setattr(T, "TASK_ROWS", 120)
    long = docs.filter("doc_id < 40").withColumns({"doc_id": F.col("doc_id") + 5000, "text": F.concat("text", F.lit(" zwölfmal" * 9000))})
    more, marks = docs.unionByName(long), labels.unionByName(labels.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000))
    counted, keep = [], T.fresh
    monkeypatch.setattr(T, "fresh", lambda seen, n, seed: counted.append((int(n.sum()), int(seen.sum(0).max()))) or keep(seen, n, seed))
    met, mean = [], T.meet
    monkeypatch.setattr(T, "meet", lambda model, parts: met.append(sorted(n for n, _ in parts)) or mean(model, parts))
    model = T.fit(more, marks)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4))
    assert counted[0][0] == marks.filter(draw != 3).count() and all(sum(m) == counted[0][0] and len(m) > 1 for m in met) and len(met) == 6
    at = T.Hasher()("zwölfmal")[0, 0]
    assert model.language_words[at].max() > -2  # 360,000 of the words
    rows = T.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.95


def exchanged(node, column):
    """Exchanges of a physical plan that the column passes through."""
    below = node.children()
    own = node.nodeName() == "Exchange" and f" {column}#" in node.output().mkString(" ", " ", "")
    return own + sum(exchanged(below.apply(i), column) for i in range(below.size()))


def test_words_are_exchanged_once(labelled, monkeypatch, spark):
    """Where the labels are too many for a broadcast too: the training takes the partitions of the join. More rows
    make more partitions, not more models."""
    monkeypatch.setattr(T, "TASK_ROWS", 120)
    monkeypatch.setattr(T, "TASKS", 2)
    met, mean = [], T.meet
    monkeypatch.setattr(T, "meet", lambda model, parts: met.append([n for n, _ in parts]) or mean(model, parts))
    plans, keep = [], T.shared_checkpoint
    monkeypatch.setattr(T, "shared_checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().initialPlan()) or keep(df))
    for most in ("-1", "10m"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            T.fit(*labelled, rounds=1)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    taught = labelled[1].filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) != 3).count()
    assert [len(m) for m in met] == [2, 2] and [sum(m) for m in met] == [taught, taught] and "(doc_id#" in plans[0].toString() and ", 5)" in plans[0].toString()
    assert [exchanged(p, "x") for p in plans] == [1, 1] and plans[0].toString().count("MapInPandas") == 1
