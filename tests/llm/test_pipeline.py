import random
import re
from pathlib import Path

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilespark.llm import toxicity
from tilespark.llm.common import id_remainder

from .conftest import DOCS, awkward_rows, prose
from .test_simhash_dedup import by_hand, components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_takes_awkward_rows(spark, tmp_path):
    docs = spark.createDataFrame(awkward_rows(), DOCS)
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == COLUMNS
    assert docs.count() > 0


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_every_stage_takes_an_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), SF).count() == 0


def test_decisions_take_effect(spark):
    stages = dict(C.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = stages["toxicity"](spark, docs, SF)
    assert 0.7 * docs.count() < toxic.count() < docs.count()
    lines = stages["line_dedup"](spark, docs, SF)
    assert lines.count() == docs.count() and lines.filter("length(text) <> n_chars").count() == docs.filter("length(text) <> n_chars").count()
    near = stages["simhash_dedup"](spark, docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")), SF)
    assert near.filter("doc_id >= 100000").count() == 0 and near.count() > 0.8 * docs.count()
    mixed = stages["mixing"](spark, docs, SF)
    words = lambda d: sum(len(r["text"].split()) for r in d.collect())
    assert words(mixed) == pytest.approx(1.5 * words(docs), rel=0.1)


def test_every_stage_takes_clashing_columns(spark):
    """Columns with names that the stages use for themselves stay as they are."""
    clash = ("kept_", "drops_", "copies_", "rows_", "place_", "copy_", "mix_id_", "mix_key_", "toxicity_score_", "n_lines_", "n_dropped_", "id_", "row_", "score", "component_id", "taken", "size", "turn", "part", "ids")
    docs = spark.createDataFrame(awkward_rows(), DOCS).withColumns({c: F.lit(f"own {c}") for c in clash})
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clash), name
    assert C.pack(spark, docs, SF).count()


# ---------------------------------------------------------------- a plain version of the stages


def tokens_of(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    some = sum(bool(re.search("[0-9]", w)) for w in words)
    return tuple("<*>" if re.search("[0-9]", w) else w for w in words) if 2 * some <= len(words) else tuple(words)


def plain_line_dedup(texts):
    """id -> text: every two templates of a leaf are compared."""
    first, last = {}, {}
    for i in sorted(texts):
        for line in (texts[i] or "").split("\n"):
            if t := tokens_of(line):
                first.setdefault(t, i)
                last[t] = i
    cut = dict(first)
    leaves = {}
    for t in first:
        if len(t) - 1 >= 0.8 * len(t):
            leaves.setdefault((len(t), t[:4]), []).append(t)
    for own in leaves.values():
        if len(own) < 2 or min(map(first.get, own)) == max(map(last.get, own)):
            continue
        for t in own:
            cut[t] = min([cut[t], *(first[o] for o in own if sum(x != y for x, y in zip(t, o)) == 1)])
        general = {}
        for t in own:
            shared = [[o for o in own if o[k] == x] for k, x in enumerate(t)]
            fixed = [len(o) > 1 and min(map(first.get, o)) < max(map(last.get, o)) for o in shared]
            if len(t) > sum(fixed) >= 0.8 * len(t):
                general.setdefault(tuple(x if f else None for x, f in zip(t, fixed)), []).append(t)
        for group in general.values():
            for t in group:
                cut[t] = min(cut[t], min(map(first.get, group)))
    keep = lambda i, line: not tokens_of(line) or i <= cut[tokens_of(line)]
    return {i: None if t is None else "\n".join(line for line in t.split("\n") if keep(i, line)) for i, t in texts.items()}


def plain_targets(sizes, sources):
    """Source -> target, filled up step by step."""
    names = sorted({s for s in sources.values() if s is not None}) + [None] * (None in sources.values())
    total = {n: sum(sizes[i] for i in sizes if sources[i] == n) for n in names}
    weight, target, left = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}, {}, 1.5 * sum(total.values())
    while open_ := [n for n in names if n not in target]:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = [n for n in open_ if share[n] > 2 * total[n]]
        for n in full or open_:
            target[n] = min(share[n], 2.0 * total[n])
        left -= sum(target[n] for n in full)
        if not full:
            break
    return target


def test_run_document_by_document(spark, tmp_path):
    """run() against plain Python, but for the scores of the classifier and the draws of the mix, which have bounds instead."""
    rng = random.Random(21)
    bad = ["idiot", "moron", "scum"]
    texts = {}
    for i in range(120):
        words = prose(rng, rng.randint(30, 200)).split()
        if i % 6 == 0:
            words = [w if rng.random() < 0.8 else rng.choice(bad) for w in words]
        texts[i] = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
    for i in range(1, 120, 7):
        texts[i] += "\nAll rights reserved.\nuser said that it is fine and " + rng.choice(["Alice", "Robert", "Carol"]) + " will pay for it soon"
    texts |= {200 + i: texts[i] for i in (1, 2, 3, 4)} | {300: texts[5] + " tail", 301: None, 302: ""}
    sources = {i: [None, "b", "c", "d"][i % 4] for i in texts}
    spark.createDataFrame([(i, t, "en", sources[i], len(t or "")) for i, t in texts.items()], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = C.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    learn = docs.filter(id_remainder(F.col("doc_id")) != 0)
    labels = spark.read.parquet(str(tmp_path / "labels.parquet")).filter(id_remainder(F.col("doc_id")) != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(learn, labels)).collect()}
    clean = {i: t for i, t in texts.items() if scores[i] < 0.5}
    assert sum(i % 6 == 0 for i in clean if i < 120) <= 2 and len(clean) >= 100
    deduped = plain_line_dedup(clean)
    assert sum(t != texts[i] for i, t in deduped.items()) >= 10
    fp = {i: by_hand(t) for i, t in deduped.items()}
    group = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    left = {i: t for i, t in deduped.items() if group[i] == i}
    assert len(left) < len(deduped)

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {i: [*encode(t or "", add_special_tokens=False).ids, 2] for i, t in left.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], list(np.frombuffer(r["token_bytes"], "<u4"))))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(pieces[r["doc_id"]][-1][1])
    copies = dict.fromkeys(left, 0)
    for i, own in pieces.items():
        assert i in left
        copies[i] = sum(start == 0 for start, _ in own)
        cover = np.zeros(len(ids[i]), int)
        for start, part in own:
            assert part == ids[i][start : start + len(part)]
            cover[start : start + len(part)] += 1
        assert (cover == copies[i]).all()
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in left.items()}
    for source, target in plain_targets(sizes, {i: sources[i] for i in left}).items():
        own = [i for i in left if sources[i] == source]
        assert abs(sum(copies[i] * sizes[i] for i in own) - target) <= max(sizes[i] for i in own) and max(copies[i] for i in own) <= 2
    assert not any(f.name == "toxicity" for f in Path(spark.conf.get("spark.checkpoint.dir")).glob("pipeline-*/*"))
