import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilespark.llm import packing as P

from .conftest import DOCS, awkward_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, docs, length):
    """Round trip: sequences are gapless and of the right sizes, documents are whole."""
    model = Tokenizer.from_file(PATH)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length and at & (at - 1) == 0
    wanted = defaultdict(list)
    for doc, text, *_ in docs:
        wanted[doc].append([*model.encode(text or "", add_special_tokens=False).ids, 2])
    assert set(pieces) == set(wanted)
    for doc, texts in wanted.items():
        assert sum(r["length"] for r in pieces[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            ids = [i for r in sorted(pieces[doc], key=lambda r: r["start"]) for i in np.frombuffer(r["token_bytes"], "<u4").tolist()]
            assert ids == texts[0] and all(r["doc_tokens"] == len(ids) for r in pieces[doc])


@pytest.mark.parametrize("length", [64, 4096])
def test_round_trip(spark, length):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.choice([0, 3, 40, 300])), "en", "s", 0) for i in range(80)]
    check_pieces(P.pack(spark.createDataFrame(docs, DOCS).repartition(3), PATH, length=length).collect(), docs, length)


def test_awkward(awkward, nothing):
    check_pieces(P.pack(awkward, PATH).collect(), awkward_rows(), 4096)
    assert P.pack(nothing, PATH).count() == 0


def test_little_padding_is_none(spark):
    rows = P.pack(spark.createDataFrame([(1, "one two three", "en", "s", 0)], DOCS), PATH).collect()
    assert [r["length"] for r in rows] == [4]


def test_words_equal_whole_texts():
    ours, model, rng = P.WordTokenizer(PATH, most=40), Tokenizer.from_file(PATH), random.Random(1)
    texts = ["a" + chr(c) + "b" for c in range(0x3100)] + [a + b + c for a in ("", "(", "'", "-", ".'") for b in ("s", "ab", "re", "é", "7", "İx", "") for c in ("", "'", "'s", ".", ",!!", "%%%", ")'")]
    texts += ["x <|endoftext|> y", "ΣΑΣ Σ.", "don't we'll I'm", "ﬁ ǅ ª º ² 漢字", "á é"] + ["".join(rng.choice("aZé'.,! \n1<|>ß-") for _ in range(30)) for _ in range(500)]
    for text, ids in zip(texts, ours.batch(texts)):
        assert np.frombuffer(ids, ours.kind).tolist() == model.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_that_recur_stay_known():
    """Words of seven letters are among the frequent ones; longer ones give way, to be learned again."""
    ours = P.WordTokenizer(PATH, most=5)
    ours.encode("sevenly eightlys one two three four")
    ours.encode("another text")
    assert "sevenly" in ours.known and "eightlys" not in ours.known
    assert P.WordTokenizer(PATH).most >= 450_000


@pytest.mark.parametrize("text", ["", "abc", "abcd", "abcde", "größer als ein Block, 漢字 " * 9])
def test_counts_of_grams(text):
    raw, wanted = text.encode(), np.zeros(P.HASHED)
    for i in range(len(raw) - 3):
        wanted[(int.from_bytes(raw[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    for block in (1, 7, 1 << 20):
        counts = P.hashed_counts(text, block=block)
        assert counts is None if len(raw) < 4 else counts.tolist() == wanted.tolist()


def test_hilbert_steps_are_unit_steps():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = P.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_like_documents_are_neighbours():
    rng = random.Random(2)
    kinds = [[w * 2 for w in "abcdef"], [w * 3 for w in "uvwxyz"]]
    texts = [" ".join(rng.choices(kinds[i % 2], k=200)) for i in range(60)]
    order = np.argsort(P.curve_keys(texts, list(range(60)), P.directions(6)))
    changes = int((np.diff(order % 2) != 0).sum())
    assert changes < 12
    assert P.hashed_counts("abcdefgh" * 50, block=64).tolist() == P.hashed_counts("abcdefgh" * 50).tolist()
    assert zlib.crc32(b"") == 0


def test_rows_alike_are_dealt_to_several_ranges(spark):
    docs = spark.createDataFrame([(7, "the same words in every row " * 20, "en", "s", 0)] * 600 + [(i, f"others {i}", "en", "s", 0) for i in range(8, 20)], DOCS).repartition(5)
    rows = P.pack(docs, PATH).collect()
    whole = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(r["length"] for r in rows) == 600 * whole[7] + sum(n for i, n in whole.items() if i != 7)
    assert len({r["sequence_id"] >> 40 for r in rows if r["doc_id"] == 7}) > 1
