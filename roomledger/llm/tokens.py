"""Token ids of a batch of texts with a public tokenizer, one encoding per distinct word.

The word-level tokenizer splits at white space before anything else, and none of its
steps looks across it, so the ids of a text are the ids of its words in order. A Python
worker keeps the ids of the words it has met, also over tasks (at most ``CACHE_WORDS``,
then it starts anew), and assembles texts with array operations. Words are told apart by a 64-bit hash.

A new word of printable ASCII and Latin-1 letters needs little of the tokenizer's
normaliser: NFC and white space leave it as it is, and the pattern's letter and digit
classes are a-z with the small letters of Latin-1, and 0-9, once it is in lower case.
Its pieces go straight to the tokenizer's model. All other words,
those with ``<|`` (special tokens), and every word of a tokenizer with other steps, take
the whole tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from roomledger.llm import words as w

CACHE_WORDS = 1_000_000
WORD_BPE = "word_bpe_49k.json"

# The steps before the model of the word-level tokenizer.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# SPLIT on such words in lower case
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_SMALL = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def tokenizer_file(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of this Python worker; what it has learnt changes no result."""
    return Encoder(path, plain)


class Encoder:
    """Encodes Arrow text columns. ``plain`` reads special tokens' names as text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        steps = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.split = (
            [x and json.loads(x.__getstate__()) for x in steps] == [NORMALIZER, PRE_TOKENIZER]
            and self.tokenizer.post_processor is None
            and all(t.special and t.content.startswith("<|") for t in special)
        )
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in _SMALL})
        self._reset()

    def _reset(self) -> None:
        # Arrays instead of a dict: a word takes 16 bytes and its ids, not some hundreds of bytes of objects.
        self.known = np.zeros(0, dtype=np.uint64)  # hashes of the learnt words, sorted
        self.start = np.zeros(0, dtype=np.uint32)
        self.size = np.zeros(0, dtype=np.uint32)
        self.store = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of every word."""
        out: list[list[int] | None] = [None] * len(texts)
        if self.split:
            model, known = self.tokenizer.model, {}
            for i, text in enumerate(texts):
                if _PLAIN.fullmatch(text) and "<|" not in text:
                    text = text.lower()
                    if text.isalpha():
                        out[i] = [t.id for t in model.tokenize(text if text.isascii() else text.translate(self.signs))]
                        continue
                    ids: list[int] = []
                    for piece in _PIECES.findall(text):
                        if piece not in known:
                            known[piece] = [t.id for t in model.tokenize(piece if piece.isascii() else piece.translate(self.signs))]
                        ids += known[piece]
                    out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        whole = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, whole, strict=True):
            out[i] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Adds words that are not known; ``hashes`` sorted."""
        lists = self._ids(texts)
        sizes = np.fromiter(map(len, lists), dtype=np.uint32, count=len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum()))
        self.store = _room(self.store, self.used + len(flat))
        self.store[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.size = np.insert(self.size, at, sizes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(sizes) - sizes)
        self.used += len(flat)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the known words, and whether it is there."""
        at = np.searchsorted(self.known, hashes)
        if not len(self.known):
            return at, np.zeros(len(hashes), dtype=bool)
        return at, self.known[np.minimum(at, len(self.known) - 1)] == hashes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets; null text has no ids."""
        data, at = w.buffers(texts)
        found = w.segments(data, at)
        kinds, where, which = np.unique(found.hash, return_index=True, return_inverse=True)
        slots, there = self._places(kinds)
        if not there.all():
            if len(self.known) + np.count_nonzero(~there) > CACHE_WORDS:
                self._reset()
                there[:] = False
            new = np.flatnonzero(~there)
            spans = zip(found.start[where[new]].tolist(), found.end[where[new]].tolist(), strict=True)
            raw = memoryview(data)
            self._learn(kinds[new], [str(raw[a:b], "utf-8") for a, b in spans])
            slots = np.searchsorted(self.known, kinds)
        slots = slots[which]
        sizes = self.size[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.start[slots] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[found.rows]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end`` to every row."""
    n = len(at) - 1
    to = at + np.arange(n + 1)
    out = np.full(int(to[-1]), end, dtype=np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
    return out, to
