import random

import public_tokenizers

from tilespark.llm import token_counts as T

from .conftest import DOCS, awkward_rows, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(pieces, worst, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        choice = (best[end - 1][0] + worst * n, best[end - 1][1] + n)
        for start in range(end - 1, -1, -1):
            score = pieces.get(word[start:end])
            if score is not None and best[start][0] + score > choice[0]:
                choice = (best[start][0] + score, best[start][1] + 1)
        best.append(choice)
    return best[-1][1]


def test_trie_equals_brute_force():
    pieces, rng = T.load_pieces(PATH), random.Random(4)
    trie = T.ForwardTrie(pieces)
    for _ in range(400):
        word = T.MARK + "".join(rng.choice("abcdeéß漢tionsr") for _ in range(rng.randint(0, 14)))
        assert trie.insert(word) == brute(pieces, trie.worst, word)
    assert len(trie) < sum(map(len, trie.terminal)) + 1  # prefixes are shared


def test_very_long_words(monkeypatch):
    """Words that reach beyond the trie, alone and with a prefix in common, against the same brute force."""
    pieces, rng = T.load_pieces(PATH), random.Random(6)
    monkeypatch.setattr(T, "DEEP", 12)
    trie = T.ForwardTrie(pieces)
    start = "".join(rng.choice("abcdetionsr") for _ in range(30))
    for n in (11, 12, 13, 40, 400):
        for _ in range(10):
            word = T.MARK + start[: rng.randint(0, 30)] + "".join(rng.choice("abcdeéß漢tionsr") for _ in range(n))
            assert trie.insert(word) == brute(pieces, trie.worst, word)
    assert max(map(len, trie.terminal), default=0) <= 12 and len(trie) < 12 * 60


def test_one_huge_word_leaves_the_trie_small(spark):
    docs = spark.createDataFrame([(0, "ab" * 300_000 + " tion", "en", "s", 0), (1, "ab tion", "en", "s", 0)], DOCS)
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs, PATH, max_nodes=100).collect()}
    assert got[0] > 50_000 and got[1] == sum(brute(T.load_pieces(PATH), T.ForwardTrie(T.load_pieces(PATH)).worst, T.MARK + w) for w in ("ab", "tion"))


def test_counts(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(0, 50)) for _ in range(40)]
    pieces = T.load_pieces(PATH)
    worst = T.ForwardTrie(pieces).worst
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in T.token_counts(docs, PATH).collect()}
    again = {r["doc_id"]: r for r in T.token_counts(docs, PATH, max_nodes=50).collect()}  # the trie starts anew all the time
    for i, t in enumerate(texts):
        assert got[i]["n_pretokens"] == len(t.split()) and got[i]["n_distinct"] == len(set(t.split()))
        assert got[i]["n_tokens"] == sum(brute(pieces, worst, T.MARK + w) for w in t.split())
    assert got == again


def test_awkward(awkward, nothing):
    rows = T.token_counts(awkward, PATH).collect()
    assert len(rows) == len(awkward_rows()) and {r["n_tokens"] for r in rows if r["doc_id"] in (30, 31, 32)} == {0}
    assert T.token_counts(nothing, PATH).count() == 0
