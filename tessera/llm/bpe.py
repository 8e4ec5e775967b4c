"""Exact and fast encoders for two kinds of public BPE vocabularies.

Both give the ids of the tokenizers library for the same file.  They gain over
it by caching ids by word: words are cut only where the library's own pattern
always cuts, so that a word's ids don't depend on its neighbours.  Texts or
words outside the cases reasoned about below go to the library itself.

``ids`` are passed on as packed little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re
from array import array
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words that an encoder remembers: when half as many are new, those not asked for since the last such time are forgotten.
CACHE_WORDS = 400_000
#: Longer words aren't remembered.
CACHE_WORD_CHARS = 64

# The split pattern of the byte-level vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The split pattern of the lower-case word vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
# The mark of a word's last piece in that vocabulary.
WORD_END = "</w>"

_SPACE_BEFORE_SPACE = re.compile("[\x85\xa0  -     　] ")
_ASCII_PAIRS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
#: Characters whose case, class and normal form are the same in every library here.
_SIMPLE = re.compile("[\t\n\r !-~¡-įı-ɏ]*")
#: Letters among them, then marks that begin no special token: a piece of letters and a piece of marks.
_PLAIN = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([!-/:;=>?@\[-`{}~]*)")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Cache(dict):
    """Word to packed ids; asks for a missing word once.  ``old`` are the words of the half before."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask
        self.old = {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.ask(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Byte-level BPE.

    A white-space character after another character always starts a new piece
    under BYTE_PATTERN, and the scan has no look-behind: encoding may restart
    at a space whose predecessor is no white space.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = 1 + max([*ranks.values(), *self.special.values()])
        self.table = [b""] * size
        for token, i in ranks.items():
            self.table[i] = token
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.cache = _Cache(lambda word: pack(self.fast.encode_ordinary(" " + word)))

    def has_special(self, text: str) -> bool:
        return any(token in text for token in self.special)

    def encode(self, text: str) -> bytes:
        if self.has_special(text):
            return pack(self.library.encode(text, add_special_tokens=False).ids)
        if any(pair in text for pair in _ASCII_PAIRS) or not text.isascii() and _SPACE_BEFORE_SPACE.search(text):
            return pack(self.fast.encode_ordinary(text))
        first, *rest = text.split(" ")
        return b"".join([pack(self.fast.encode_ordinary(first)), *map(self.cache.__getitem__, rest)])

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    # ------------------------------------------------------------ long texts

    def encode_long(self, text: str, leaf_chars: int, threads: int = 2) -> bytes:
        """Tree concatenation: leaves in parallel, then joins of neighbours level by level."""
        if len(text) <= leaf_chars:
            return self.encode(text)
        depth = max(1, (-(-len(text) // leaf_chars) - 1).bit_length())
        cuts = [len(text) * i >> depth for i in range((1 << depth) + 1)]
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        with ThreadPoolExecutor(threads) as pool:
            parts = list(pool.map(self.encode, leaves))
            while len(parts) > 1:
                parts = list(pool.map(self.join, parts[::2], parts[1::2]))
        return parts[0]

    def join(self, left: bytes, right: bytes, agree: int = 4, window: int = 16) -> bytes:
        """The ids of the joined text.

        Re-encodes a window around the join.  BPE ids are right when every
        neighbouring pair is, so once the window begins with ids of the left
        side and ends with ids of the right side, everything outside it stands.
        If they don't agree the window grows, to the whole text at most.
        """
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        while True:
            start, end = max(0, len(a) - window), min(len(b), window)
            while start > 0 and self._inside(a[start]):
                start -= 1
            while end < len(b) and self._inside(b[end]):
                end += 1
            middle = self.decode_bytes(left[4 * start :]) + self.decode_bytes(right[: 4 * end])
            again = np.frombuffer(self.encode(middle.decode("utf-8")), "<u4")
            n = min(agree, len(again))
            begins = start == 0 or n == agree <= len(a) - start and np.array_equal(again[:n], a[start : start + n])
            ends = end == len(b) or n == agree <= end and np.array_equal(again[-n:], b[end - n : end])
            if begins and ends:
                return left[: 4 * start] + again.tobytes() + right[4 * end :]
            window *= 2

    def _inside(self, token: int) -> bool:
        """Does the token begin within a character?"""
        return self.table[token][0] & 0xC0 == 0x80


class WordBpe:
    """BPE with word ends over lower-cased words; white space is dropped.

    No piece spans white space, so each blank-separated word stands alone.
    A word's end is a byte that UTF-8 never has, whose merges come first, as
    the marked last letters come first in the vocabulary.
    """

    END = b"\xff"

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = len(token) > len(WORD_END) and token.endswith(WORD_END)
                letters = token[: -len(WORD_END)] if ends else token
                ranks[bytes(alphabet[c] for c in letters) + self.END * ends] = i
        self.fast = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.piece = self.fast._encode_single_piece
        self.pattern = regex.compile(WORD_PATTERN)
        self.cache = _Cache(self._word)
        self.pieces = _Cache(lambda piece: pack(self.piece(piece.encode() + self.END)))

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            ids = self.pieces[letters.lower()]
            return ids + self.pieces[marks] if marks else ids
        if "<|" in word or not _SIMPLE.fullmatch(word):
            return pack(self.library.encode(word, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
