"""Token ids of whole texts by the tokenizers library, one call for each distinct part of a word.

The vocabulary in use (lower case, parts by a split pattern, byte-level merges with word ends) drops white space
before its merges, so the ids of a text are those of its words between ASCII white space, one after the other.  A
batch's words are dictionary-encoded; each distinct word is split into the pattern's parts, each new part goes to the
library's merges, and the batch's ids are gathered from the words' by NumPy.

This holds for vocabularies whose normalizer and pre-tokenizer are those of :data:`CHAIN`; any other goes through the
library's whole chain, text by text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the id that ends each document.
END_ID = 2

#: The normalizer and the pre-tokenizer that the shortcut stands for.
CHAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Words of characters below this are split here; the others go through the whole tokenizer.
_PLAIN_END = 0x180
_TAILS = ".,;:!?"


def _class_of(kind: str) -> str:
    """The body of a character class: the characters below ``_PLAIN_END`` of a Unicode category."""
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


def gather(pool: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``at`` of ``pool``, which holds entries of ``sizes`` one after the other: (values, ends of the entries)."""
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    first = (np.cumsum(sizes) - sizes)[at] - (ends - lengths)
    return pool[np.repeat(first, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


class Generations(dict):
    """Keys to values, made by ``make``; keeps between ``limit`` and twice as many.

    When full, what is held becomes the old generation, from which entries still in use come back.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids; parts once met are kept, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 200_000, bytes_at_once: int = 6 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.bytes_at_once = Tokenizer.from_file(path), bytes_at_once
        chain = json.loads(self.tokenizer.to_str())
        model = chain["model"]
        # special tokens are found before the normalizer; the shortcut knows only those that begin with "<|"
        self.shortcut = all(chain.get(k) == v for k, v in CHAIN.items()) and model["type"] == "BPE" and not model.get("dropout") and all(t["content"].startswith("<|") for t in chain["added_tokens"])
        self.merges, self.alphabet = self.tokenizer.model, _byte_alphabet()
        letters, numbers = _class_of("L"), _class_of("N")
        self.splitter = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")
        # white space beyond ASCII and characters whose lower case is longer are left to the library
        self.odd = re.compile(f"[^\x21-\x84\x86-\x9f\xa1-{chr(_PLAIN_END - 1)}]|[İŉ]|<\\|")
        # most words: letters and at most one mark after them
        self.simple = f"^[{letters.replace('İ', '').replace('ŉ', '')}]+[{_TAILS}]?$"
        self.parts = Generations(self.part, limit)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        word = part if part.isascii() and part.isalnum() else "".join([self.alphabet[b] for b in part.encode()])
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def word(self, word: str) -> bytes:
        if self.odd.search(word):
            return self.whole(word)
        return b"".join([self.parts[p] for p in self.splitter.findall(word.lower())])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word)."""
        simple = pc.match_substring_regex(words, self.simple)
        low = pc.utf8_lower(words.filter(simple))
        stems = pc.utf8_rtrim(low, _TAILS)
        tailed = pc.binary_length(low).to_numpy() > pc.binary_length(stems).to_numpy()
        tails = low.filter(pa.array(tailed))
        last = np.frombuffer(tails.buffers()[2] or b"", np.uint8)[np.frombuffer(tails.buffers()[1], np.int32)[tails.offset + 1 : tails.offset + len(tails) + 1] - 1] if len(tails) else np.empty(0, np.uint8)
        stems = stems.dictionary_encode()
        parts = self.parts
        bodies = [b"", *[parts[x] for x in _TAILS], *[parts[x] for x in stems.dictionary.to_pylist()]]
        # each word is two entries: its stem and its mark, or its whole and nothing
        at = np.zeros((len(words), 2), np.int64)
        own = simple.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(own)
        at[rows, 0] = stems.indices.to_numpy() + 1 + len(_TAILS)
        of_tail = np.zeros(128, np.int64)
        of_tail[list(_TAILS.encode())] = np.arange(1, len(_TAILS) + 1)
        at[rows[tailed], 1] = of_tail[last]
        at[~own, 0] = np.arange(len(bodies), len(bodies) + len(words) - len(rows))
        bodies += [self.word(w) for w in words.filter(pc.invert(simple)).to_pylist()]
        ids, ends = gather(np.frombuffer(b"".join(bodies), np.uint32), np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4, at.reshape(-1))
        return ids, np.diff(ends[1::2], prepend=0)

    def encode(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` after it; ids of each text)."""
        if not self.shortcut:
            found = [np.concatenate([np.frombuffer(self.whole(t), np.uint32), end]) for t in texts.to_pylist()]
            return np.concatenate([end[:0], *found]), np.array([len(x) for x in found], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        pool, sizes = self.words(words.dictionary)
        # every text is its words and one entry more, the end
        stops = np.cumsum(np.diff(lists.offsets.to_numpy()).astype(np.int64) + 1)
        at = np.full(len(words) + len(texts), len(sizes), np.int64)
        own = np.ones(len(at), bool)
        own[stops - 1] = False
        at[own] = words.indices.to_numpy()
        ids, ends = gather(np.concatenate([pool, end]), np.append(sizes, len(end)), at)
        return ids, np.diff(ends[stops - 1], prepend=0)

    def __call__(self, texts: pa.Array, end_id: int | None = END_ID):
        """(first row, ids of all its texts, ids of each text) for one slice of rows after the other; null is the empty text."""
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for start, stop in slices(texts, self.bytes_at_once):
            yield start, *self.encode(pc.fill_null(texts.slice(start, stop - start), ""), end)
        self.parts.old = {}


def slices(texts: pa.Array, bytes_at_once: int):
    """(first row, row after the last) of runs of rows that hold about ``bytes_at_once``, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + bytes_at_once, side="right")))
        yield start, stop
        start = stop


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary; kept from task to task."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = Encoder(path)
    return _READY[path]
