"""Operator 9: a convolutional text classifier for toxicity, trained in numpy.

A word is the sum of three hashed embeddings: of itself and of its first four and five bytes. Filters of one, two and
three words run over the whole text, the maximum of each feeds a logistic layer. Gradients reach only the places where a
filter has its maximum. Thresholds are calibrated for each language on rows kept from training; the language of a text is
guessed from its words, since labels, lang, source and id are never inputs of a score. The score is shifted by the
threshold, so that 0.5 separates the classes in every language.
"""

from __future__ import annotations

import copy
import pickle
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import needed_nodes
from .common import shared_checkpoint, small_batches

BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMS = 12
SPLIT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


class Hasher:
    """Buckets of words; remembers a bounded number of them."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, tuple[int, int, int]] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        """(words, 3) buckets; bucket 0 is for padding."""
        known, out = self.known, []
        for w in (text or "").lower().encode("utf-8", "surrogatepass").translate(SPLIT).split():
            t = known.get(w)
            if t is None:
                if len(known) >= self.most:
                    known.clear()
                t = known[w] = tuple(zlib.crc32(x) % (BUCKETS - 1) + 1 for x in (w, b"4" + w[:4], b"5" + w[:5]))
            out.append(t)
        return np.array(out, np.int32).reshape(-1, 3)


def flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in one array, each with padding behind it; where they start; where no filter may begin, since it would
    reach into the next document. A document without words has its first padding."""
    pad = np.zeros((max(WIDTHS), 3), np.int32)
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(np.r_[0, sizes + len(pad)])[:-1]
    blocked = np.ones(int(sizes.sum()) + len(pad) * len(docs), bool)
    for s, n in zip(starts.tolist(), sizes.tolist()):
        blocked[s : s + max(n, 1)] = False
    return np.concatenate([x for d in docs for x in (d, pad)]), starts, blocked


@dataclass
class ConvModel:
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    const: float = 0.0
    shift: float = 0.0
    languages: list[str] = field(default_factory=list)
    language_words: np.ndarray | None = None
    shifts: np.ndarray | None = None

    def pooled(self, x: np.ndarray, starts: np.ndarray, blocked: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each document."""
        e, parts = self.embed[x].sum(1), []
        for w in WIDTHS:
            z = e @ self.filters[w][:DIMS]
            for j in range(1, w):
                z[:-j] += e[j:] @ self.filters[w][j * DIMS : (j + 1) * DIMS]
            z[blocked] = -np.inf
            parts.append(np.maximum.reduceat(z, starts, axis=0) + self.bias[w])
        return np.tanh(np.concatenate(parts, 1))

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Before calibration; documents go through in groups of bounded size."""
        out, group, size = [], [], 0
        for d in docs:
            group.append(d)
            size += len(d)
            if size > 100_000:
                out.append(self.pooled(*flat(group)) @ self.out + self.const)
                group, size = [], 0
        if group:
            out.append(self.pooled(*flat(group)) @ self.out + self.const)
        return np.concatenate(out) if out else np.zeros(0)

    def language(self, d: np.ndarray) -> int:
        """The most likely language of the words, or -1."""
        if not self.languages or not len(d):
            return -1
        return int(self.language_words[d[:, 0]].sum(0).argmax())

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.logits(docs)
        z = z - np.array([self.shift if (k := self.language(d)) < 0 else self.shifts[k] for d in docs])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(model: ConvModel, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted cross-entropy, with a small penalty on filters and output, and its gradients; those of the embeddings
    without the padding."""
    kind = model.embed.dtype
    x, starts, blocked = flat(docs)
    e = model.embed[x].sum(1)
    ends = np.r_[starts[1:], len(x)]
    hidden, places = [], {}
    for w in WIDTHS:
        z = e @ model.filters[w][:DIMS]
        for j in range(1, w):
            z[:-j] += e[j:] @ model.filters[w][j * DIMS : (j + 1) * DIMS]
        z[blocked] = -np.inf
        places[w] = np.array([s + z[s:t].argmax(0) for s, t in zip(starts, ends)])
        hidden.append(z[places[w], np.arange(FILTERS)] + model.bias[w])
    h = np.tanh(np.concatenate(hidden, 1))
    logit = np.clip(h @ model.out + model.const, -30, 30)
    p = 1 / (1 + np.exp(-logit))
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).mean()) + 5e-5 * float((model.out**2).sum() + sum((f**2).sum() for f in model.filters.values()))
    g = ((p - y) * weight / len(docs)).astype(kind)
    grads = {"const": np.array(g.sum()), "out": h.T @ g + 1e-4 * model.out, "embed": np.zeros_like(model.embed)}
    back = (g[:, None] * model.out) * (1 - h * h)
    for k, w in enumerate(WIDTHS):
        b = back[:, k * FILTERS : (k + 1) * FILTERS]
        grads[f"b{w}"], gf = b.sum(0), np.zeros_like(model.filters[w])
        for j in range(w):
            at_j = np.minimum(places[w] + j, len(x) - 1)
            part = slice(j * DIMS, (j + 1) * DIMS)
            gf[part] = np.einsum("nfd,nf->df", e[at_j], b)
            ge = b[:, :, None] * model.filters[w][part].T[None]
            for c in range(3):
                np.add.at(grads["embed"], x[at_j, c].ravel(), ge.reshape(-1, DIMS))
        grads[f"f{w}"] = gf + 1e-4 * model.filters[w]
    grads["embed"][0] = 0
    return loss, grads


def fresh(seen: np.ndarray, n: np.ndarray, seed: int = 9) -> ConvModel:
    """Before training. The first dimension of the embeddings is the shrunken log-odds of a bucket's presence in the two
    classes: ``seen`` (2, BUCKETS) counts the rows that hold it, of ``n`` rows of each class."""
    rng = np.random.default_rng(seed)
    model = ConvModel(
        rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32), {w: rng.normal(0, 0.3, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
    )
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    model.embed[:, 0] += 0.3 * odds * (seen.sum(0) / (seen.sum(0) + 10))
    model.embed[0] = 0
    for w in WIDTHS:
        model.filters[w][0, : FILTERS // 2] += 1.0
    return model


def parameters(model: ConvModel) -> dict[str, np.ndarray]:
    return {"out": model.out, **{f"f{w}": model.filters[w] for w in WIDTHS}, **{f"b{w}": model.bias[w] for w in WIDTHS}, "embed": model.embed}


def descend(model: ConvModel, rows: Iterator[tuple[np.ndarray, int]], weights: tuple[float, float], *, rate: float = 0.01, batch: int = 64, most_words: int = 100_000) -> int:
    """Adam over batches of whole documents (words, label), in place; the number of documents. A batch ends early beyond
    ``most_words`` words."""
    params = parameters(model)
    first, second = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    step = n = words = 0
    docs: list[np.ndarray] = []
    labels: list[int] = []
    for d, label in chain(rows, [(None, 0)]):
        if d is not None:
            docs.append(d)
            labels.append(label)
            words += len(d)
        if docs and (d is None or len(docs) >= batch or words >= most_words):
            y = np.array(labels)
            _, grads = gradients(model, docs, y, np.where(y == 1, weights[1], weights[0]))
            model.const -= rate * float(grads["const"])
            step, n = step + 1, n + len(docs)
            for k, v in params.items():
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
            docs, labels, words = [], [], 0
    return n


def meet(model: ConvModel, parts: list[tuple[int, tuple[float, dict[str, np.ndarray]]]]) -> None:
    """The mean of models (constant, parameters) that set out from ``model``, by their numbers of documents; of an embedding, the mean of those that
    have moved it."""
    total, own = sum(n for n, _ in parts), parameters(model)
    others = [(n, params) for n, (_, params) in parts]
    model.const = sum(n * const for n, (const, _) in parts) / total
    for k, v in own.items():
        if k != "embed":
            v[:] = sum(n * o[k].astype(np.float64) for n, o in others) / total
    moved, by = np.zeros(model.embed.shape), np.zeros(len(model.embed))
    for n, o in others:
        far = (o["embed"] != model.embed).any(1)
        moved[far] += n * (o["embed"][far] - model.embed[far])
        by[far] += n
    model.embed += (moved / np.maximum(by, 1)[:, None]).astype(np.float32)


def best_shift(z: np.ndarray, y: np.ndarray, n: np.ndarray, positive_weight: float) -> float:
    """The middle of the widest run of thresholds with the best weighted F1, where ``n`` rows have ``z`` and ``y`` each."""
    values, at = np.unique(-z, return_inverse=True)
    hits = np.cumsum(np.bincount(at, n * (y == 1), len(values))) * positive_weight
    alarms = np.cumsum(np.bincount(at, n * (y == 0), len(values)))
    i = int((2 * hits / np.maximum(hits + alarms + hits[-1], 1e-9)).argmax())
    below = -values[i + 1] if i + 1 < len(values) else -values[i] - 2
    return float((below - values[i]) / 2)


#: Labelled rows that one task trains on, and tasks at most: beyond that, tasks get more rows.
TASK_ROWS, TASKS = 6000, 32


def unpacked(rows: pd.DataFrame) -> Iterator[np.ndarray]:
    return (np.frombuffer(zlib.decompress(x), "<u2").astype(np.int32).reshape(-1, 3) for x in rows["x"])


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int | None = None, rounds: int = 6, max_languages: int = 16, seed: int = 9) -> ConvModel:
    """Learn from all labelled rows of ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, toxic in 0/1).

    Three quarters of them, by a hash of the id, train; the others calibrate. In each round every task trains on its rows,
    from the same model, and the models meet in their mean. Counts of words, and of logits for the thresholds (in steps of
    1/256), are over all rows. The driver sees no text: counts, and at most ``TASKS`` models at a time.

    On demand, only the ``2 * per_class`` labelled rows of either class that come first by the hash. Rows whose label is null
    or neither 0 nor 1 teach nothing; of several labels of an id the largest counts. With one class alone, or none, every score is the constant rate of the class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw, natural = F.xxhash64("doc_id", F.lit(seed)), 1.0
    if per_class is not None:
        sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        natural = sizes.get(1, 0) / max(1, min(sizes.get(1, 0), 2 * per_class)) / max(1, sizes.get(0, 0)) * max(1, min(sizes.get(0, 0), 2 * per_class))
        one, two = (usable.filter(F.col("toxic") == label).orderBy(draw, "doc_id").limit(2 * per_class) for label in (0, 1))
        usable = one.unionByName(two)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for rows in batches:
            yield rows.drop(columns="text").assign(x=[zlib.compress(hasher(t).astype("<u2").tobytes(), 1) for t in rows["text"]])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # texts without a label stay where they are, but for a few
    near = needed_nodes(texts.withColumn("id", F.col("doc_id")), usable.select(F.col("doc_id").alias("node_id"))).select("doc_id", "text", "lang")
    dealt = max(1, -(-usable.count() // TASK_ROWS))
    tasks = min(TASKS, dealt)  # of the training; it takes whole partitions, whose number follows the rows
    # both sides are dealt alike before the join, so that the words are exchanged once, whatever the join
    words = near.mapInPandas(hashed, "doc_id long, lang string, x binary").repartition(dealt, "doc_id")
    found = words.join(usable.repartition(dealt, "doc_id"), "doc_id").withColumn("draw", draw).withColumn("keep", F.pmod("draw", F.lit(4)) != 3)
    rows = shared_checkpoint(found)
    shares = {(r["toxic"], r["keep"]): r["n"] for r in rows.groupBy("toxic", "keep").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([shares.get((label, True), 0) + shares.get((label, False), 0) for label in (0, 1)])
    if not n.all():
        model = fresh(np.zeros((2, BUCKETS)), n, seed)
        model.out[:] = 0
        model.const = -20.0 if not n[1] else 20.0
        return model
    if not all(shares.get((label, True)) for label in (0, 1)):
        rows = rows.withColumn("keep", F.lit(True))  # too few to part
    held_too = all(shares.get((label, False)) for label in (0, 1))
    names = [r["lang"] for r in rows.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a class with a bucket (0, 1), words of a language (2 and more)."""
        table = np.zeros((2 + len(names), BUCKETS), np.int64)
        place = {name: 2 + k for k, name in enumerate(names)}
        for part in batches:
            for d, label, keep, lang in zip(unpacked(part), part["toxic"], part["keep"], part["lang"]):
                if keep:
                    table[label, np.unique(d)] += 1
                if lang in place:
                    np.add.at(table[place[lang]], d[:, 0], 1)
        a, b = np.nonzero(table)
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": table[a, b]})

    table = np.zeros((2 + len(names), BUCKETS))
    counted = rows.mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    table[counted["a"], counted["b"]] = counted["n"]
    trained = rows.filter("keep")
    kept = np.array([r["n"] for r in trained.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic").collect()])
    model, weights = fresh(table[:2], kept, seed), tuple((kept.sum() * 0.5 / kept).tolist())
    for k in range(rounds):

        def learn(batches: Iterator[pd.DataFrame], start: ConvModel = model) -> Iterator[pd.DataFrame]:
            own = copy.deepcopy(start)
            n = descend(own, ((d, int(label)) for part in batches for d, label in zip(unpacked(part), part["toxic"])), weights)
            if n:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "model": [zlib.compress(pickle.dumps((own.const, parameters(own))), 1)]})

        order = trained.coalesce(tasks).sortWithinPartitions(F.xxhash64("draw", F.lit(k)), "doc_id", "x")
        parts = sorted(order.mapInPandas(learn, "part int, n long, model binary").collect(), key=lambda r: r["part"])
        meet(model, [(r["n"], pickle.loads(zlib.decompress(r["model"]))) for r in parts])
    if len(names) > 1:
        words = table[2:].T + 0.1
        model.languages, model.language_words = names, np.log(words / words.sum(0)).astype(np.float32)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = list(unpacked(part))
            yield pd.DataFrame({"toxic": part["toxic"], "own": [model.language(d) for d in x], "z": np.round(np.clip(model.logits(x), -30, 30) * 256).astype(np.int32)})

    held = rows.filter("NOT keep") if held_too else rows
    seen = held.mapInPandas(logits, "toxic int, own int, z int").groupBy("toxic", "own", "z").agg(F.count(F.lit(1)).alias("n")).toPandas()
    y, own, z, many = seen["toxic"].to_numpy(), seen["own"].to_numpy(), seen["z"].to_numpy() / 256, seen["n"].to_numpy()
    model.shift = best_shift(z, y, many, natural)
    model.shifts = np.full(len(names), model.shift)
    for k in range(len(model.languages)):
        part = own == k
        if min(many[part & (y == label)].sum() for label in (0, 1)) >= 8:
            model.shifts[k] = best_shift(z[part], y[part], many[part], natural)
    return model


def with_score(docs: DataFrame, model: ConvModel, name: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and the score of the whole text as ``name``, in place of an input column of that name;
    null and empty texts are scored as no words."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for texts in batches:
            yield pd.Series(model.score([hasher(t) for t in texts]).astype(float))

    return docs.withColumn(name, run(F.col(text_col).cast("string")))


def score(docs: DataFrame, model: ConvModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``, from the text alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"))
    return with_score(rows, model, text_col="text_").select("doc_id", "score")
