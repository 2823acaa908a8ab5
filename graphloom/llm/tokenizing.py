"""Exact tokenization by the tokenizers library behind worker-wide caches.

Text is cut only where the library's own pre-tokenizer always cuts, so pieces can be encoded apart and
remembered. Texts that hold an added token's string go to the library whole.
"""

from __future__ import annotations

import array
import os
import re
import sys

#: Entries of each of a cache's two generations: bounds a worker's memory.
MOST_CACHED = 400_000
#: Pieces longer than this are encoded, not remembered.
LONGEST_CACHED = 64
#: What the library's regular expressions call white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")

_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once for each worker, without truncation or padding."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def path_of(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level vocabularies write each byte.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SEEN)}
#: Letters for which lower case and composed form do not depend on their neighbours.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+")


class Bounded(dict):
    """A dictionary in two generations of MOST_CACHED entries at most: when the younger is full it becomes the elder, and
    what is asked for again moves back, so that entries in use are never lost all at once."""

    def __init__(self, *start) -> None:
        super().__init__(*start)
        self.elder: dict = {}

    def keep(self, key, value) -> None:
        if len(self) >= MOST_CACHED:
            self.elder = dict(self)
            self.clear()
        self[key] = value


class WordIds(Bounded):
    """Ids of white-space-separated words as little-endian unsigned bytes; for vocabularies that drop white space and case.

    Holds words as written and their cores in lower case without final stops and commas. A core of
    plain letters is one pre-token, so the library's model encodes it without the steps before; other words
    go through the whole library.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        #: No word without what all added tokens begin with holds one.
        self.mark = os.path.commonprefix([t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]) or b""
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"

    def __missing__(self, word: bytes) -> bytes:
        out = self.elder.get(word)
        if out is None:
            core = word.rstrip(b".,")
            if not core[-1:].isalnum():  # a stop may belong to a run of other marks
                core = word
            # Added tokens are met as written, so lower case may not make one.
            low = core.isalpha() or (core.isascii() and self.mark not in core)
            out = self._core(core.lower() if low else core)
            if len(core) < len(word):
                out += self._core(word[len(core) :])
        if len(word) <= LONGEST_CACHED:
            self.keep(word, out)
        return out

    def _core(self, core: bytes) -> bytes:
        out = self.get(core)
        if out is not None or (out := self.elder.get(core)) is not None:
            return out
        if core.isalpha():
            ids = [t.id for t in self.model.tokenize(core.decode())]
        else:
            text = core.decode()
            if _PLAIN.fullmatch(text):
                ids = [t.id for t in self.model.tokenize("".join([BYTE_CHARS[b] for b in text.lower().encode()]))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = _little(self.code, ids)
        if len(core) <= LONGEST_CACHED:
            self.keep(core, out)
        return out

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def _little(code: str, ids: list[int]) -> bytes:
    out = array.array(code, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceLengths(Bounded):
    """Token counts of pieces; ``frequent`` is the first tier, this dictionary's misses the second."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.tokenizer = load(path)
        self.frequent = frequent
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> int:
        n = self.elder.get(piece) or self.frequent.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST_CACHED:
            self.keep(piece, n)
        return n

    def count(self, text: str) -> int:
        if any(a in text for a in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, PIECE.findall(text)))


def word_ids(path: str) -> WordIds:
    key = f"ids:{path}"
    if key not in _LOADED:
        _LOADED[key] = WordIds(path)
    return _LOADED[key]


def piece_lengths(path: str, frequent: dict[str, int], tag: object = None) -> PieceLengths:
    key = f"lengths:{path}"
    if key not in _LOADED or _LOADED[key][0] != tag:
        _LOADED[key] = (tag, PieceLengths(path, frequent))
    return _LOADED[key][1]
