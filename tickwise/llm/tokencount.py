"""Token counts by a shared-prefix unigram segmentation (operator 3).

Texts are cut at white space; each word, with the word-begin mark in front, is
a pre-token.  Its token count is that of its best segmentation under a unigram
model (pieces with log scores), found by the forward recursion

    best[i] = max over pieces that end at i of best[i - len(piece)] + score(piece)

Distinct pre-tokens form a trie.  A prefix's forward score and token count
depend on the prefix alone, so each trie node is computed once, whichever and
however many words run through it; the node of a whole word stores the word's
count.  The trie lives in the Python worker across Arrow batches and starts
anew beyond ``MAX_NODES`` nodes, so memory is bounded and a task can be rerun
anywhere.  Words are counted where they are read: no shuffle.

Scores come from a SentencePiece model file.  A merge-ordered file stores
ranks, not log probabilities; they become ``-log(1 + rank)`` by Zipf's law
(``scores="stored"`` takes the file's values).  A character that no piece
covers counts as its UTF-8 bytes, scored ``UNKNOWN`` each.  Ties take the
segmentation with fewer tokens.

Defined results: null and empty texts have 0 words, 0 tokens and score 0.0.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickwise.llm.common import appended, text_slices, with_columns

MARK = "▁"
UNKNOWN = -20.0
MAX_NODES = 300_000


@lru_cache(maxsize=2)
def load_pieces(path: str, scores: str = "zipf") -> dict[str, float]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        value = sp.get_score(i)
        out[sp.id_to_piece(i)] = value if scores == "stored" else -math.log(2.0 + abs(value))
    return out


class Suffixes:
    """Automaton over the pieces: a state lists (length, score) of every piece that ends there."""

    def __init__(self, pieces: dict[str, float]):
        self.step: dict[tuple[int, str], int] = {}
        self.fail, self.ends = [0], [[]]
        depth_first = []
        for piece, score in pieces.items():
            state = 0
            for c in piece:
                nxt = self.step.get((state, c))
                if nxt is None:
                    nxt = self.step[(state, c)] = len(self.fail)
                    self.fail.append(0)
                    self.ends.append([])
                    depth_first.append((state, c, nxt))
                state = nxt
            self.ends[state] = [(len(piece), score)]
        depth = [0] * len(self.fail)
        for state, _, nxt in depth_first:
            depth[nxt] = depth[state] + 1
        self.tree = dict(self.step)
        for state, c, nxt in sorted(depth_first, key=lambda e: depth[e[2]]):
            back = self.fail[state]
            while back and (back, c) not in self.tree:
                back = self.fail[back]
            target = self.tree.get((back, c), 0)
            self.fail[nxt] = target if target != nxt else 0
            self.ends[nxt] = self.ends[nxt] + self.ends[self.fail[nxt]]

    def go(self, state: int, c: str) -> int:
        found = self.step.get((state, c))
        if found is None:
            back = state
            while back and (back, c) not in self.tree:
                back = self.fail[back]
            found = self.tree.get((back, c), 0)
            if len(self.step) < 4 * len(self.tree) + 100_000:  # remembered, within bounds
                self.step[(state, c)] = found
        return found


class PrefixTrie:
    """Nodes are (parent, character); each holds forward score, token count and automaton state of its prefix.

    The root stands for the word-begin mark.
    """

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.suffixes = Suffixes(pieces)
        self.computed = 0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count, self.state = [], [], []
        self.words: dict[str, int] = {}
        self.start = (0.0, 0)  # before the mark
        self.node(MARK, 0, [])

    def node(self, c: str, state: int, path: list[int]) -> int:
        """Compute the prefix that ``c`` ends; ``path`` are the nodes before it, ``state`` that of the last one."""
        best, count = self.best, self.count
        extra = len(c.encode())
        state = self.suffixes.go(state, c)
        top, n = (best[path[-1]], count[path[-1]]) if path else self.start
        top, n = top + extra * UNKNOWN, n + extra
        for length, score in self.suffixes.ends[state]:
            at = len(path) - length
            if at >= 0:
                at = path[at]
                score, tokens = score + best[at], count[at] + 1
            elif at == -1:
                tokens = 1
            else:
                continue
            if score > top or (score == top and tokens < n):
                top, n = score, tokens
        best.append(top)
        count.append(n)
        self.state.append(state)
        self.computed += 1
        return len(best) - 1

    def insert(self, word: str, before: str = "", path: list[int] | None = None) -> list[int]:
        """Nodes along ``word``; ``path`` are those along ``before``, whose common prefix is not walked again."""
        shared = 0
        if path:
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            path = path[: shared + 1]
        else:
            path = [0]
        child, at = self.child, path[-1]
        for c in word[shared:]:
            found = child.get((at, c))
            if found is None:
                found = child[(at, c)] = self.node(c, self.state[at], path)
            at = found
            path.append(at)
        self.words[word] = at
        return path

    def add_all(self, words: set[str]) -> None:
        """Make every word known, in sorted order so that neighbours share their walk."""
        if len(self.best) > self.max_nodes:
            self.clear()
        before, path = "", None
        for w in sorted(words.difference(self.words)):
            path = self.insert(w, before, path)
            before = w


def count_tokens(df: DataFrame, path: str, text: str = "text", scores: str = "zipf") -> DataFrame:
    """All columns of ``df`` and ``n_words``, ``n_tokens`` (long) and ``score``, the sum of the words' best scores."""
    added = [("n_words", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("score", pa.float64(), "double")]
    kept, schema = appended(df, added)

    def run(batches):
        trie = PrefixTrie(load_pieces(path, scores))
        for batch in text_slices(batches, text):
            words = [t.split() if t else [] for t in batch.column(text).to_pylist()]
            trie.add_all(set().union(*words))
            count, best = np.array(trie.count), np.array(trie.best)
            nodes = [np.fromiter(map(trie.words.__getitem__, ws), np.int64, len(ws)) for ws in words]
            out = [[len(ns) for ns in nodes], [int(count[ns].sum()) for ns in nodes], [float(best[ns].sum()) for ns in nodes]]
            yield with_columns(batch, kept, [(n, pa.array(v, t)) for (n, t, _), v in zip(added, out)])

    return df.mapInArrow(run, schema)
