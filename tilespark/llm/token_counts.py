"""Operator 2: token counts by a unigram model, with forward scores shared along a trie of pre-tokens.

Every distinct pre-token goes into a trie. A node holds the best forward score (and its number of tokens) of the prefix
that it stands for, so a prefix shared by many pre-tokens is scored once; the node where a pre-token ends stores its
count. Documents then add up the stored counts. The trie lives in a worker; it is started anew when it has grown past
``max_nodes``, which changes the work but never a result.

The model: the pieces of a public vocabulary file with log-probabilities after Zipf's law of their rank. A character that
no piece covers costs its UTF-8 bytes as tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A word starts with this mark, as the vocabulary file has it.
MARK = "▁"
#: So many characters of a pre-token go into the trie.
DEEP = 512


def load_pieces(path: str) -> dict[str, float]:
    """piece -> log-probability; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(names))))
    return {name: -math.log(rank + 1) - total for rank, name in enumerate(names)}


class ForwardTrie:
    """Prefix tree with a forward score at every node. Edges lie in one table, from node and character to node."""

    def __init__(self, pieces: dict[str, float]):
        #: every suffix of a piece, with the score of those that are pieces: a search backwards ends at the first miss
        self.suffixes: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))} | pieces
        self.worst = min(pieces.values(), default=0.0) - 10.0
        self.longest = max(map(len, pieces), default=1)
        self.edges: dict[int, int] = {}
        self.score, self.tokens, self.terminal = [0.0], [0], {}

    def clear(self) -> None:
        self.edges, self.score, self.tokens, self.terminal = {}, [0.0], [0], {}

    def step(self, word: str, depth: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """Best score and number of tokens of the first ``depth`` characters; ``before``: those of the shorter prefixes, of
        which the last ones are enough."""
        ch, suffixes, have = word[depth - 1], self.suffixes, len(before)
        n = 1 if ch < "\x80" else len(ch.encode("utf-8", "surrogatepass"))
        best, count = before[-1][0] + self.worst * n, before[-1][1] + n
        for back in range(1, have + 1):
            piece = suffixes.get(word[depth - back : depth], 0)
            if piece == 0:
                break
            if piece is not None and (s := before[-back][0] + piece) > best:
                best, count = s, before[-back][1] + 1
        return best, count

    def insert(self, word: str) -> int:
        """Walk down, scoring only nodes that are new; the count of the word, kept for later. Beyond DEEP characters a word
        shares nothing with others: its rest is scored in passing, and nothing of it is kept."""
        edges, scores, tokens, suffixes = self.edges, self.score, self.tokens, self.suffixes
        path, node, depth = [0], 0, 0
        for ch in word[:DEEP]:
            depth += 1
            edge = node << 21 | ord(ch)
            child = edges.get(edge)
            if child is None:  # the same as ``step``, on the scores of the nodes, since most of the time goes here
                n = 1 if ch < "\x80" else len(ch.encode("utf-8", "surrogatepass"))
                best, count = scores[node] + self.worst * n, tokens[node] + n
                start = depth
                while start:
                    start -= 1
                    piece = suffixes.get(word[start:depth], 0)
                    if piece == 0:
                        break
                    if piece is not None and (s := scores[path[start]] + piece) > best:
                        best, count = s, tokens[path[start]] + 1
                child = edges[edge] = len(scores)
                scores.append(best)
                tokens.append(count)
            node = child
            path.append(node)
        if len(word) <= DEEP:
            self.terminal[word] = tokens[node]
            return tokens[node]
        before = [(scores[i], tokens[i]) for i in path]
        for depth in range(DEEP + 1, len(word) + 1):
            before.append(self.step(word, depth, before))
            if len(before) > 4096 + self.longest:
                del before[: -self.longest]
        return before[-1][1]

    def __len__(self) -> int:
        return len(self.score)


def token_counts(docs: DataFrame, vocabulary: str, *, max_nodes: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_distinct, n_tokens) per row of ``docs``; no shuffle.

    Pre-tokens are the runs between ASCII white space, each with a word mark before it. Null and blank texts have zero
    of everything; repeated rows are counted separately. Other columns are not looked at, whatever their names. A worker's
    trie holds ``max_nodes`` nodes and one more pre-token of DEEP characters at most, also within one very long text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, known = ForwardTrie(load_pieces(vocabulary)), {}
        for rows in batches:
            out = []
            for text in rows["text"]:
                words, total = Counter((text or "").encode("utf-8", "surrogatepass").split()), 0
                for word, n in words.items():
                    count = known.get(word)
                    if count is None:
                        if len(trie) > max_nodes:
                            trie.clear()
                            known.clear()
                        count = trie.insert(MARK + word.decode("utf-8", "surrogatepass"))
                        if len(word) <= DEEP:
                            known[word] = count
                    total += count * n
                out.append((sum(words.values()), len(words), total))
            yield pd.DataFrame({"doc_id": rows["doc_id"], **{k: pd.array([x[i] for x in out], dtype="int64") for i, k in enumerate(("n_pretokens", "n_distinct", "n_tokens"))}})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
