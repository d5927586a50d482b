"""Operator 6: pack documents into token sequences along a Hilbert curve.

A document's counts of hashed byte 4-grams, of length one, are projected to three normal directions; the place on the Hilbert curve
through that cube is its key. Documents are range-partitioned and sorted by the key and laid end to end along the curve, so
neighbours of like content share sequences. A sequence is full at ``length`` tokens; the tokens left at the end of a
partition fill sequences of falling powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches

AXES, BITS, HASHED = 3, 10, 4096
PIECE = "doc_id long, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long, curve_key long"
#: White space for str.split() but not for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Words of up to so many characters stay known when there are too many.
SHORT_WORD = 7
#: A point or comma that does not stand between a letter or number and white space.
LOOSE_MARK = re.compile(r"[.,](?:(?<![^\W_].)|(?!\s|\Z))")
HEAD_MARKS = string.punctuation.replace("'", "")


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells, by exchange and inversion of bit planes (Skilling 2004)."""
    x = cells.astype(np.int64).copy()
    n, axes = x.shape
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(axes):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def directions(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(HASHED, AXES))


def hashed_counts(text: str | None, block: int = 1 << 16) -> np.ndarray | None:
    """Counts of the hashed byte 4-grams of a whole text; None if it has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) < 4:
        return None
    counts = np.zeros(HASHED, np.int64)
    for at in range(0, len(raw) - 3, block):
        # little-endian numbers that begin at every byte
        gram = np.ndarray(min(block, len(raw) - 3 - at), "<u4", raw, at, 1) * np.uint32(2654435761)
        gram >>= np.uint32(20)
        counts += np.bincount(gram.view(np.int32), minlength=HASHED)
    return counts.astype(np.float64)


def curve_keys(texts: list[str | None], doc_ids: list[int | None], table: np.ndarray) -> np.ndarray:
    """Hilbert key of each text, above 31 bits of a hash of the id that tells equal texts apart."""
    points = np.zeros((len(texts), AXES))
    for row, text in enumerate(texts):
        counts = hashed_counts(text)
        if counts is not None:
            points[row] = counts @ table / np.linalg.norm(counts)
    share = 0.5 * (1 + np.tanh(0.79788456 * (points + 0.044715 * points**3)))  # close to the normal distribution function
    cells = np.clip(share * (1 << BITS), 0, (1 << BITS) - 1)
    ties = np.fromiter((zlib.crc32(str(d).encode()) >> 1 for d in doc_ids), np.int64, len(doc_ids))
    return hilbert_key(cells) << 31 | ties


class WordTokenizer:
    """Ids of a ``tokenizers`` file whose pre-tokens never cross white space; remembers words.

    A word is what lies between white space. A run of letters is one pre-token, and so is the run of ASCII marks before or
    after it (but for an apostrophe before letters). Runs of Latin letters, which lower-casing maps one to one, go straight
    to the model; all other new words go through the whole tokenizer. Texts that hold special tokens or odd control
    characters are encoded whole.
    """

    def __init__(self, path: str, most: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        # byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.marks = {"": b""}
        self.known: dict[str, bytes] = {}
        self.most = most

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        known, marks, tokenize = self.known, self.marks, self.model.model.tokenize
        for w in words:
            head = mark = ""
            body = w
            if not w.isalpha():
                body = w.rstrip(string.punctuation)
                mark, size = w[len(body) :], len(body)
                body = body.lstrip(HEAD_MARKS)
                head = w[: size - len(body)]
                if not body.isalpha():
                    known[w] = self.packed([w])[0]
                    continue
            if not body.isascii() and max(body) >= "\u0130":
                known[w] = self.packed([w])[0]
                continue
            body = body.lower()
            ids = known.get(body)
            if ids is None:
                plain = body if body.isascii() else body.encode().decode("latin-1").translate(self.alphabet)
                ids = known[body] = array(self.kind.char, [t.id for t in tokenize(plain)]).tobytes()
            if mark or head:
                for x in (mark, head):
                    if x not in marks:
                        marks[x] = self.packed([x])[0]
                ids = marks[head] + ids + marks[mark]
            known[w] = ids

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        if not text:
            return b""
        if any(c in text for c in ODD_SPACE) or any(t in text for t in self.special):
            return self.packed([text])[0]
        # in most prose every point and comma ends a word: there they are words of their own, and fewer words are new
        words = (text if LOOSE_MARK.search(text) else text.replace(".", " .").replace(",", " ,")).split()
        if new := set(words).difference(self.known):
            if len(self.known) > self.most:  # the short words are the frequent ones
                self.known, self.marks = {w: v for w, v in self.known.items() if len(w) <= SHORT_WORD}, {"": b""}
                new = set(words).difference(self.known)
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        return list(map(self.encode, texts))


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The one tokenizer of a Python worker, with the words that its tasks have met."""
    return WordTokenizer(path)


def pack_partition(end_id: int, length: int, kind: str):
    """Rows (doc_id, part, curve_key, ids) in order to pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sequence, filled, waiting = -1, 0, 0, []

        def emit(pieces: list[tuple], size: int) -> list[tuple]:
            """Pieces (doc_id, key, start, ids, doc_tokens) as one sequence."""
            nonlocal sequence
            out, at = [], 0
            for doc, key, start, ids, total in pieces:
                out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, (part << 40) + sequence, at, key))
                at += len(ids)
            assert at == size
            sequence += 1
            return out

        def tail() -> list[tuple]:
            """What waits, in falling powers of two."""
            nonlocal filled, waiting
            out = []
            while filled:
                size, own, room = 1 << (filled.bit_length() - 1), [], 1 << (filled.bit_length() - 1)
                while room:
                    doc, key, start, ids, total = waiting.pop(0)
                    own.append((doc, key, start, ids[:room], total))
                    if len(ids) > room:
                        waiting.insert(0, (doc, key, start + room, ids[room:], total))
                    room -= len(own[-1][3])
                out += emit(own, size)
                filled -= size
            return out

        frame = lambda out: pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"doc_id": "Int64"})
        for rows in batches:
            out = []
            for doc, p, key, packed in zip(rows["doc_id"].array, rows["part"], rows["curve_key"], rows["ids"]):
                if p != part:
                    out += tail()
                    part, sequence = int(p), 0
                ids = np.append(np.frombuffer(packed, kind), np.array(end_id, kind))
                start, total, doc = 0, len(ids), None if pd.isna(doc) else int(doc)
                while start < total:
                    take = min(total - start, length - filled)
                    waiting.append((doc, int(key), start, ids[start : start + take], total))
                    start, filled = start + take, filled + take
                    if filled == length:
                        out += emit(waiting, length)
                        waiting, filled = [], 0
            if out:
                yield frame(out)
        if filled:
            yield frame(tail())

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2, seed: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, token_bytes, doc_tokens, sequence_id, offset, curve_key).

    ``length`` is a power of two. token_bytes holds the ids as little-endian 32-bit numbers. Null and empty texts are the
    end id alone. Repeated rows are packed separately; so many that their key fills several ranges are dealt to all of them.
    Other columns are not looked at, whatever their names. An empty table gives no piece. The only driver state are the bounds
    of the ranges, quantiles over the keys of all documents.
    """
    assert length & (length - 1) == 0, "the length must be a power of two"
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = shuffle_partitions(spark)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = directions(seed)
        for rows in batches:
            texts, ids = list(rows["text"]), [None if pd.isna(d) else int(d) for d in rows["doc_id"]]
            # long texts weigh more, so that ranges hold like amounts of text
            yield pd.DataFrame({"curve_key": np.repeat(curve_keys(texts, ids, table), [1 + len(t or "") // 4096 for t in texts])})

    found = docs.mapInPandas(keys, "curve_key long").agg(F.percentile_approx("curve_key", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0]
    bounds = np.array(sorted(found or []), np.float64)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, words, turn = directions(seed), word_tokenizer(tokenizer), 0
        for rows in batches:
            texts, ids = list(rows["text"]), [None if pd.isna(d) else int(d) for d in rows["doc_id"]]
            key = curve_keys(texts, ids, table)
            # a key that fills whole ranges is dealt to all of them in turn; quantiles are doubles, so keys compare as such
            place = key.astype(np.float64)
            low, high = np.searchsorted(bounds, place, "left"), np.searchsorted(bounds, place, "right")
            part = np.where(high - low > 1, low + (turn + np.arange(len(key))) % (high - low + 1), low)
            turn += len(key)
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "part": part.astype(np.int32), "curve_key": key, "ids": words.batch(texts)})

    kind = WordTokenizer(tokenizer).kind.str
    dealt = docs.mapInPandas(tokens, "doc_id long, part int, curve_key long, ids binary").repartitionById(max(n, len(bounds) + 1), F.col("part"))
    return dealt.sortWithinPartitions("part", "curve_key", "doc_id", "ids").mapInPandas(pack_partition(end_id, length, kind), PIECE)
