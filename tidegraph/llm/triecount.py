"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's space mark before it.  The distinct pre-tokens of a slice of texts go into
a trie; the best score of a prefix (over all ways to cut it into vocabulary pieces) and its token count belong to the
trie node, so they are computed once for all words that begin so.  The count at a word's end node is kept for the
word, and a document's count is the sum over its words.  No data is shuffled; a task holds one slice's trie.

The trie grows level by level, a level's nodes being the distinct pairs of a node above and a character, and a level's
scores are computed at once: from each node a walk up the trie reads a suffix of its prefix, in step with a trie of the
reversed pieces, and every piece met gives a way to come from the node where it begins.

Scores: the vocabulary files at hand hold no unigram scores and tokenizers are not trained here, so a piece of rank r
has log probability -ln(r + 1) - ln H (Zipf's law); a character outside the vocabulary costs one token for each of its
UTF-8 bytes, at the best byte's rank.  Of equal scores the cut with fewer tokens counts.

Defined results: null text counts as empty and has 0 tokens; repeated rows each get their count; an empty table gives
an empty result; texts may be of any length: words longer than ``longest`` characters are computed one by one without
the trie; an id column named like an output column raises ValueError; other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash, tidy
from tidegraph.llm.tokens import slices, vocabulary_path

MARK = "▁"
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
#: Code points lie below this, so node * _CHARS + character is one number for each edge.
_CHARS = 0x110000


class Unigram:
    """Best segmentations of pre-tokens; see the module's text."""

    def __init__(self, pieces: list[str], longest: int = 128, bytes_at_once: int = 8 << 20):
        norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        score = {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}
        self.byte = max((score[p] for p in pieces if _BYTE.fullmatch(p)), default=-math.log(len(pieces) + 1) - norm)
        self.score = {p: s for p, s in score.items() if not _BYTE.fullmatch(p)}
        self.reach = max(map(len, self.score), default=1)
        self.longest, self.bytes_at_once = longest, bytes_at_once
        # the trie of reversed pieces: sorted edges, the node each leads to, and the score of the piece that ends there
        edges: dict[int, int] = {}
        at = [-math.inf]
        for p, s in self.score.items():
            node = 0
            for c in reversed(p):
                edge = node * _CHARS + ord(c)
                node = edges.setdefault(edge, len(at))
                if node == len(at):
                    at.append(-math.inf)
            at[node] = s
        keys, nodes = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64)
        order = np.argsort(keys)
        self.edges, self.targets, self.piece = keys[order], nodes[order], np.array(at)
        self.singles = np.array(sorted(ord(p) for p in self.score if len(p) == 1), np.int64)

    def count(self, word: str) -> int:
        """Tokens of one pre-token, without a trie."""
        best = [(0.0, 0)]  # (score, minus the tokens) of each prefix
        for end, char in enumerate(word, 1):
            s, n = best[-1]
            top = (s + self.byte * (k := len(char.encode())), n - k) if char not in self.score else (-math.inf, 0)
            for start in range(max(0, end - self.reach), end):
                piece = self.score.get(word[start:end])
                if piece is not None:
                    s, n = best[start]
                    top = max(top, (s + piece, n - 1))
            best.append(top)
        return -best[-1][1]

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of the distinct ``words``, the space mark put before it."""
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(sizes > self.longest).tolist():
            out[i] = self.count(MARK + words[i].as_py())
        rows = np.flatnonzero(sizes <= self.longest)
        chars = np.frombuffer(MARK.join(["", *words.take(pa.array(rows)).to_pylist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(rows):
            out[rows] = self._by_trie(chars, sizes[rows])
        return out

    def _by_trie(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.argsort(-sizes, kind="stable")  # words that end leave from the back
        first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        node = np.zeros(len(sizes), np.int64)  # where each word has come to; node 0 is the root
        above, char, score, tokens = (np.zeros(1, t) for t in (np.int64, np.int64, np.float64, np.int64))
        done = np.zeros(len(sizes), np.int64)
        for depth in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -depth, side="left"))  # words longer than depth
            edge, back = np.unique(node[:live] * _CHARS + chars[first[:live] + depth], return_inverse=True)
            base = len(above)
            up, own = np.divmod(edge, _CHARS)
            above, char = np.concatenate([above, up]), np.concatenate([char, own])
            s, n = self._level(base, above, char, score, tokens)
            score, tokens = np.concatenate([score, s]), np.concatenate([tokens, n])
            node[:live] = base + back
            ended = int(np.searchsorted(-sizes, -(depth + 1), side="left"))
            done[ended:live] = tokens[node[ended:live]]
        out = np.empty(len(sizes), np.int64)
        out[order] = done
        return out

    def _level(self, base: int, above: np.ndarray, char: np.ndarray, score: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best score, its tokens) of the nodes from ``base`` on, all of one depth."""
        own, up = char[base:], above[base:]
        size = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
        at = np.minimum(np.searchsorted(self.singles, own), len(self.singles) - 1)
        known = self.singles[at] == own if len(self.singles) else np.zeros(len(own), bool)
        best, count = np.where(known, -math.inf, score[up] + self.byte * size), np.where(known, 0, tokens[up] + size)
        live, node, state = np.arange(len(own)), np.arange(base, base + len(own)), np.zeros(len(own), np.int64)
        while len(live) and len(self.edges):
            edge = state * _CHARS + char[node]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            on = self.edges[at] == edge
            live, state, node = live[on], self.targets[at[on]], above[node[on]]
            piece = self.piece[state]
            own_score, own_count = score[node] + piece, tokens[node] + 1
            better = (own_score > best[live]) | (own_score == best[live]) & (own_count < count[live]) & np.isfinite(piece)
            best[live[better]], count[live[better]] = own_score[better], own_count[better]
            inside = node > 0
            live, state, node = live[inside], state[inside], node[inside]
        return best, count

    def __call__(self, texts: pa.Array):
        """(words, tokens) of each text, for one slice of rows after the other; null is the empty text."""
        for start, stop in slices(texts, self.bytes_at_once):
            lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(start, stop - start), ""))
            words = pc.filter(lists.flatten(), pc.greater(pc.binary_length(lists.flatten()), 0)).dictionary_encode()
            # the split leaves empty words at the ends of texts; they don't count
            filled = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy() > 0)])
            ends = filled[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            total = np.concatenate([[0], np.cumsum(self.counts(words.dictionary)[words.indices.to_numpy()])])
            yield np.diff(ends), np.diff(total[ends])


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece file, by rank; control pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]


_READY: dict[str, Unigram] = {}


def count_tokens(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens) of every whole text."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    no_clash([id_column], ["n_words", "n_tokens"])
    schema = T.StructType([docs.schema[id_column], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        if path not in _READY:
            _READY[path] = Unigram(pieces_of(path))
        for batch in batches:
            at = 0
            for n_words, n_tokens in _READY[path](batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n_words)), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)
                at += len(n_words)

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(tidy(count), schema)
