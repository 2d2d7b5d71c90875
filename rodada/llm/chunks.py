"""Cutting a text where a byte-level BPE tokenizer can never join, and caching what the pieces encode to.

The byte-level pre-tokenizer attaches a single space to the non-space that follows it, so every space that stands
before a non-space starts a new pre-token whatever came before. Cutting there gives pieces (one word with its
punctuation) that encode independently. A line end before a non-space is a pre-token of its own whatever surrounds it,
so lines encode independently too. Natural text repeats pieces, so a bounded per-worker cache of piece -> ids
replaces most library calls; the ids stay those of the library. Texts that hold an added special token go to the
library whole, because the library splits them at the special token first.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Callable

_BAD_SPACE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at each space before a non-space; all but the first piece had that space in front."""
    return text.split(" ") if _BAD_SPACE.search(text) is None else _CUT.split(text)


_LINE = re.compile(r"\n(?=\S)")


def lines(text: str) -> list[str]:
    """The text without its line ends before a non-space, cut there."""
    return _LINE.split(text) if "\n" in text else [text]


#: A run of these marks after letters is a pre-token of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


class PieceCache(dict):
    """piece -> value of prefix + piece, for values that add up over pre-tokens (ids, counts).

    Bounded by two generations of `limit` entries: when the young one is full it becomes the old one, whose entries
    come back as they are asked for, so frequent pieces survive. Long pieces aren't kept. A word with marks after it is
    put together from the two, so that rare words are worked out once.
    """

    def __init__(self, value: Callable[[str], object], limit: int = 300_000, prefix: str = " ", max_chars: int = 40, glue: bool = True):
        super().__init__()
        self.value, self.limit, self.prefix, self.max_chars = value, limit, prefix, max_chars
        self.old: dict = {}
        self.glue, self.marks = glue, {}

    def __missing__(self, piece: str):
        v = self.old.get(piece)
        if v is None:
            word = piece.rstrip(_MARKS) if self.glue else piece
            if len(word) < len(piece) and word.isalpha():
                marks = piece[len(word) :]
                if (after := self.marks.get(marks)) is None:
                    if len(self.marks) >= 10_000:
                        self.marks.clear()
                    after = self.marks[marks] = self.value(marks)
                v = self[word] + after
            else:
                v = self.value(self.prefix + piece)
        if len(piece) <= self.max_chars:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = v
        return v


def load_tokenizer(path: str):
    """The library's tokenizer with truncation and padding off."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def can_cut(path: str) -> bool:
    """True if pieces() is exact for this tokenizer: plain byte-level BPE without normalizer or template."""
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and " " not in a["content"] for a in spec["added_tokens"])
    )


def special_strings(tok) -> list[str]:
    """Strings that the library takes out of a text before anything else."""
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else one of those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTokens:
    """The library's tokens of a string of letters, with or without a blank before it: one pre-token, so the model's part
    of the library is asked at once."""

    def __init__(self, tok):
        self.tokenize, self.letters = tok.model.tokenize, byte_letters()
        self.blank = self.letters[32]

    def __call__(self, s: str) -> list | None:
        """Tokens, or None if s isn't one word."""
        if s[:1] == " ":
            core = s[1:]
            if core.isalpha():
                return self.tokenize(self.blank + core if core.isascii() else "".join([self.letters[b] for b in s.encode()]))
        elif s.isalpha():
            return self.tokenize(s if s.isascii() else "".join([self.letters[b] for b in s.encode()]))
        return None


class PieceEncoder:
    """ids of a whole text as packed unsigned integers of the machine; equal to the library's encode()."""

    def __init__(self, path: str, limit: int = 600_000):
        import numpy as np

        self.np, self.tok = np, load_tokenizer(path)
        self.words = WordTokens(self.tok)
        self.special, self.cut = special_strings(self.tok), can_cut(path)
        narrow = self.tok.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("u2" if narrow else "u4"), "H" if narrow else "I"
        self.one = struct.Struct("=" + self.code).pack
        self.head = PieceCache(self._packed, limit // 4, "")
        self.tail = PieceCache(self._packed, limit)
        self.line_end = self._packed("\n")

    def _packed(self, piece: str) -> bytes:
        found = self.words(piece) if self.cut else None
        ids = self.tok.encode(piece, add_special_tokens=False).ids if found is None else [t.id for t in found]
        return array(self.code, ids).tobytes()

    def packed(self, text: str) -> bytes:
        """ids as the bytes of an array of dtype."""
        if not self.cut or any(s in text for s in self.special):
            return self._packed(text)
        return self.line_end.join([self._line(x) for x in lines(text)])

    def _line(self, line: str) -> bytes:
        first, *rest = pieces(line)
        return self.head[first] + b"".join(map(self.tail.__getitem__, rest))

    def encode(self, text: str):
        """ids as a numpy array."""
        return self.np.frombuffer(self.packed(text), dtype=self.dtype)
