"""Token counts by trie-shared dynamic programming over distinct pre-tokens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import pieces

MARK = "▁"
#: Nodes of the trie that a task holds before it starts anew.
REMEMBERED = 1_000_000


def unigram_pieces(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with log probabilities by rank (Zipf's law).

    The file is a parameter and is only read. It ranks its pieces; 1/rank is the probability of a
    piece up to a constant. Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    return {sp.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(ids)}


class Counter:
    """Counts of the tokens in the most probable segmentation of pre-tokens, over a trie of them.

    A node of the trie stands for a prefix and keeps its forward scores: the best log probability
    and the token count of that segmentation. They follow from the nodes above when the node is made, so that
    each shared prefix is scored once for all pre-tokens inserted, whatever batch they come in.
    Counts are kept at the terminals. A character that no piece covers costs its UTF-8 bytes, one
    token each, at a score below all pieces. Of equal scores the longest last piece wins.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.longest: dict[str, int] = {}
        for p in scores:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.clear()

    def clear(self) -> None:
        self.terminal: dict[str, int] = {}
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, words: set[str]) -> None:
        child, best, count = self.child, self.best, self.count
        for w in words:
            node, path = 0, [0]
            for i, c in enumerate(w, 1):
                below = child.get((node, c))
                if below is None:
                    below = child[node, c] = len(best)
                    s, n = self.forward(w, i, path)
                    best.append(s)
                    count.append(n)
                node = below
                path.append(node)
            self.terminal[w] = count[node]

    def forward(self, w: str, i: int, path: list[int]) -> tuple[float, int]:
        """The scores of prefix w[:i] from the nodes of its own prefixes."""
        scores, best, c = self.scores, self.best, w[i - 1]
        nb = len(c.encode("utf-8", "surrogatepass"))
        s, n = best[path[i - 1]] + nb * self.byte, self.count[path[i - 1]] + nb
        for k in range(1, min(self.longest.get(c, 0), i) + 1):
            p = scores.get(w[i - k : i])
            if p is not None and best[path[i - k]] + p >= s:
                s, n = best[path[i - k]] + p, self.count[path[i - k]] + 1
        return s, n


def count_tokens(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens.

    Pre-tokens are runs of non-white-space, each preceded by the word mark. Texts are read whole
    where they lie; nothing is shuffled, and a task forgets its trie when it holds REMEMBERED
    nodes. Null and empty texts have 0 tokens; null ids, repeated rows and empty tables need no
    care; other columns are not read. The vocabulary (its file has a fixed size) is broadcast.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        counter = Counter(shared.value)
        for b in pieces(batches, "text"):
            words = [[MARK + w for w in t.split()] if t else [] for t in b.column(1).to_pylist()]
            if len(counter.best) > REMEMBERED:
                counter.clear()
            counter.insert({w for x in words for w in x} - counter.terminal.keys())
            get = counter.terminal.__getitem__
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in words], pa.int64()), pa.array(np.array([sum(map(get, x)) for x in words], np.int64))], ["doc_id", "n_words", "n_tokens"])

    return thin.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
