import hashlib
import random
import re
import zlib

import duckdb
import numpy as np

from tilespark.llm import pii as P

from .conftest import DOCS, awkward_rows

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind in P.KINDS:
        for found in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", found[0])
            if kind == "ip" and any(int(p) > 255 for p in found[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and P.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *found.span()))
    return out


def test_base_equals_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@2 -+()9b%é") for _ in range(rng.randint(0, 50)))
        assert P.base_spans(text) == brute(text), text
    text = "mail a.b@c-d.example.org, 4111 1111 1111 1111 or 4111111111111112, 10.0.0.255 10.0.0.256, +1 (632) 555-4827."
    assert [text[s:t] for _, s, t in P.base_spans(text)] == ["a.b@c-d.example.org", "10.0.0.255", "4111 1111 1111 1111", "+1 (632) 555-4827"] and P.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 200_000, "1." * 150_000, "+1" * 150_000, "a@" * 100_000):
        P.base_spans(text), P.windows(text)


def test_gradients():
    model = P.Tagger.new(3, 4, 1, np.float64)
    x, y = P.labelled_lines(3, 24, 5)
    _, grads = model.gradients(x, y)
    rng = np.random.default_rng(0)
    for name, value in model.params.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = model.gradients(x, y)[0]
            value[at] = kept - 1e-5
            down = model.gradients(x, y)[0]
            value[at] = kept
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_decoding_is_the_best_path():
    model = P.Tagger.new(3, 4, 2, np.float64)
    model.params["trans"] = np.random.default_rng(5).normal(size=(P.TAGS, P.TAGS))
    x, _ = P.labelled_lines(2, 4, 6)
    emit, trans = model.emissions(x)[0], model.params["trans"]
    for row, tags in enumerate(model.decode(x)):
        score = lambda path: emit[row, range(4), path].sum() + trans[path[:-1], path[1:]].sum()
        best = max((score(np.array(p)) for p in np.ndindex(*[P.TAGS] * 4)), default=0)
        assert abs(score(np.array(tags, int)) - best) < 1e-9


def spans_of(tags):
    out, i = set(), 0
    while i < len(tags):
        if tags[i] % 2:
            j = i + 1
            while j < len(tags) and tags[j] == tags[i] + 1:
                j += 1
            out.add((i, j, int(tags[i])))
            i = j
        else:
            i += 1
    return out


def test_held_out_lines():
    x, y = P.labelled_lines(200, 96, 99)
    found, true = ([spans_of(t) for t in tags] for tags in (P.load().decode(x), y))
    hits = sum(len(a & b) for a, b in zip(found, true))
    assert hits / sum(map(len, found)) > 0.9 and hits / sum(map(len, true)) > 0.9


def test_training_learns():
    """A short training of its own, since the weights beside the module take minutes."""
    x, y = P.labelled_lines(100, 72, 98)
    model = P.train(lines=400, rounds=4, passages=["invented words and +1 (632) 555-4827 here"])
    assert model.gradients(x, y)[0] < 0.5 * P.Tagger.new(12, 16, 8).gradients(x, y)[0]


def test_spans_planted_in_held_out_documents():
    """What the patterns cannot find, set into documents that the model was not trained on."""
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL AND doc_id >= 1000 AND doc_id < 4000").fetchall()
    held, draw = [t for d, t in rows if zlib.crc32(str(d).encode()) % 5 == 0 and len(t) < 4000][:250], P.Draw(777)
    texts, truth = [], []
    for text in held:
        words, out, spans = text.split(" "), "", []
        at = set(draw.rng.integers(0, len(words) + 1, 3).tolist())
        for i, w in enumerate([*words, ""]):
            if i in at:
                piece, own = draw.personal() if draw.rng.random() < 0.6 else (draw.other(), [])
                spans += [(P.KINDS[k], len(out) + s, len(out) + t) for k, s, t in own]
                out += piece + " "
            out += w + " "
        texts.append(out[:-1])
        truth.append(spans)
    bases = [P.base_spans(t) for t in texts]
    hits = found = wanted = 0
    for want, base, more in zip(truth, bases, P.model_spans(texts, bases, P.load())):
        want = {w for w in want if all(w[2] <= s or w[1] >= t for _, s, t in base)}
        hits, found, wanted = hits + len(want & set(more)), found + len(more), wanted + len(want)
    assert wanted > 150 and hits >= 0.9 * found and hits >= 0.9 * wanted


def test_model_adds_and_leaves_alone():
    model = P.load()
    cases = {
        "you may call (632) 555-4827 now": ["(632) 555-4827"], "amex 3782 822463 10005 ok": ["3782 822463 10005"], "version 3.4.0 of 2021-03-04, 12:30": [], "key 97ffa88d7c5f5655e365004e29bd123cdabd722a": [],
        "mail rosa.lind (at) cartera (dot) org for it": ["rosa.lind (at) cartera (dot) org"], "host 10[.]20[.]30[.]40 and 999[.]20[.]30[.]40": ["10[.]20[.]30[.]40"], "it has 12 4111 1111 1111 1111 on it": ["4111 1111 1111 1111"], "with 4111 1111 1111 1112 on it": [],
    }
    bases = [P.base_spans(t) for t in cases]
    added = [[t[s:e] for _, s, e in spans] for t, spans in zip(cases, P.model_spans(list(cases), bases, model))]
    assert added == list(cases.values())


def viterbi(emit, trans):
    """The best path by plain dynamic programming over dictionaries."""
    best = {k: (emit[0][k], [k]) for k in range(len(trans))}
    for row in emit[1:]:
        best = {k: max(((v + trans[j][k] + row[k], path + [k]) for j, (v, path) in best.items()), key=lambda x: x[0]) for k in range(len(trans))}
    return max(best.values(), key=lambda x: x[0])[1]


def test_whole_texts_against_a_second_decoder():
    """Windows of a text decoded one by one, without batches, padding or votes, then reconciled anew."""
    model, draw = P.load(), P.Draw(55)
    for n in range(25):
        text = " ".join(draw.personal()[0] if draw.rng.random() < 0.2 else draw.other() if draw.rng.random() < 0.2 else draw.word() for _ in range(40))
        votes = {}
        for s, t in P.windows(text):
            emit = model.emissions(P.codes(text[s:t])[None])[0][0]
            tags = viterbi(emit.tolist(), model.params["trans"].tolist())
            for a, b, tag in spans_of(tags):
                if (a or not s) and (b < t - s or t == len(text)):
                    votes[s + a, s + b, tag // 2] = votes.get((s + a, s + b, tag // 2), 0) + 1
        base, kept = P.base_spans(text), []
        for a, b, k in sorted(votes, key=lambda v: (-votes[v], v[0] - v[1], v)):
            if P.plausible(P.KINDS[k], text, a, b) and all(b <= s or a >= t for _, s, t in [*base, *kept]):
                kept.append((P.KINDS[k], a, b))
        assert sorted(P.model_spans([text], [base], model)[0]) == sorted(kept)


def test_query(spark):
    """Counts, digest and the line of spans, from the spans of the operator."""
    from tilespark.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in QUERIES["op8_pii"](spark, SF).collect():
        base = brute(texts[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and [r[f"n_{k}"] for k in P.KINDS] == [sum(b[0] == k for b in base) for k in P.KINDS]
        assert set(filter(None, line.split(","))) <= set(filter(None, r["spans"].split(",")))
        seen += len(base)
    assert seen


def test_windows_cover_all_triggers():
    text = ("a" * 70 + "1" + "b" * 30 + "@c") * 9 + "2" * 400
    places = P.windows(text)
    assert all(any(s <= i < t for s, t in places) for i, c in enumerate(text) if c in "012@") and all(t - s <= 128 for s, t in places)


def test_find(spark, awkward, nothing):
    model = P.load()
    docs = spark.createDataFrame([(1, "write to x@y.org or +1 (632) 555-4827 " * 3, "en", "s", 0)], DOCS)
    spans = P.find(docs, model).first()["spans"]
    assert [s["kind"] for s in spans if s["base"]] == ["email"] * 3 + ["phone"] * 3
    rows = {r["doc_id"]: r for r in P.find(awkward, model).collect()}
    assert P.find(awkward, model).count() == len(awkward_rows()) and rows[30]["spans"] == [] and rows[36]["spans"] == [] and P.find(nothing, model).count() == 0
