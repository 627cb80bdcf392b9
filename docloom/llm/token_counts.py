"""Token counts under a unigram model, by dynamic programming that a trie shares.

The model is a vocabulary of pieces with scores; a text's tokens are the segmentation of greatest total score, a
character that no piece covers counting as its UTF-8 bytes at a penalty. No piece crosses a whitespace marker, so a
text's count is the sum over its pre-tokens (a run of markers and the word after it). Distinct pre-tokens go into a
trie whose nodes hold the best score and the count of tokens up to there: the forward step is done once for each
shared prefix, and a pre-token's count is read off its last node. A task's trie is bounded; beyond `most` nodes it
starts anew, which costs time and changes nothing.

As the vocabulary given is a merge list with its ranks as scores, these are the counts of the unigram reading of it;
`pieces` counts what its own merges give.

Ties go to the longer last piece. Defined results: null and empty texts have 0 tokens; repeated rows count alike; an
empty table gives an empty result; texts are counted whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from math import inf
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TEXTS, id_and_text, map_arrow
from .pieces import MARK, marked_words, read_model

#: Taken off the least score for a character without a piece.
PENALTY = 10.0


def unigram(model: bytes) -> dict[str, float]:
    """Pieces and scores of a SentencePiece model's ordinary pieces, read as a unigram model."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    return {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}


class ForwardTrie:
    """Pre-tokens, and for each prefix the best score and its number of tokens."""

    def __init__(self, scores: dict[str, float], most: int = 800_000):
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("this vocabulary has pieces that cross whitespace markers")
        self.most = most
        self.unknown = min(scores.values(), default=0.0) - PENALTY
        # every ending of a piece, with its score if it is a piece itself
        self.ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.ends.update(scores)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = array("d", [0.0]), array("i", [0])
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The count of tokens of a pre-token; only the part that no earlier one shares is computed."""
        child, best, tokens, ends = self.child, self.best, self.tokens, self.ends
        path = [0]
        for i, c in enumerate(word):
            edge = (path[i], c)
            node = child.get(edge)
            if node is None:
                top, count = -inf, 0
                for j in range(i, -1, -1):
                    s = ends.get(word[j : i + 1], False)
                    if j == i and not isinstance(s, float):  # no piece for this character: its bytes
                        top, count = self.unknown + best[path[i]], tokens[path[i]] + len(c.encode("utf-8", "surrogatepass"))
                    if s is False:
                        break
                    if s is None:
                        continue
                    s += best[path[j]]
                    if s >= top:
                        top, count = s, tokens[path[j]] + 1
                node = child[edge] = len(best)
                best.append(top)
                tokens.append(count)
            path.append(node)
        return tokens[path[-1]]

    def count(self, words: list[str]) -> int:
        """Total over a text's pre-tokens, each given without its first marker."""
        terminal = self.terminal
        try:
            return sum(itemgetter(*words)(terminal)) if len(words) > 1 else sum(terminal[w] for w in words)
        except KeyError:
            pass
        total = 0
        for w in words:
            n = terminal.get(w)
            if n is None:
                n = terminal[w] = self.insert(MARK + w)
            total += n
        if len(self.best) > self.most:
            self.clear()
        return total


_tries: dict[str, ForwardTrie] = {}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of docs."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.md5(model).hexdigest()
        if key not in _tries:
            _tries[key] = ForwardTrie(unigram(model))
        trie = _tries[key]
        for b in batches:
            texts = b.column(1).to_pylist()
            pre, n = [], []
            for t in texts:
                words = marked_words(t)
                pre.append(len(words))
                n.append(trie.count(words))
            yield pa.record_batch([b.column(0), pa.array(np.array(pre, np.int64)), pa.array(np.array(n, np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, n_pretokens long, n_tokens long", TEXTS)
