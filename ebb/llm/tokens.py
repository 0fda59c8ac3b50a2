"""Byte-level BPE encoding inside Spark tasks, with the tokenizers library.

A byte-level BPE never merges across the pieces of its split pattern, so the
ids of a piece do not depend on its neighbours. Each Python worker remembers
the ids of pieces it has met (the memory is emptied when it holds too many) and
asks the library's BPE model for new ones only. Texts for which the split by
pattern could differ from the library's own (rare scripts, control characters,
the strings of added tokens) are encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

#: Finds a character outside the plain set: printable ASCII, tab, line ends and
#: the Latin letters and signs up to U+024F. Within that set Python's ``re`` with
#: the classes below splits as the libraries' Unicode patterns do.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]")
_MEMO = 400_000
assert array("I").itemsize == 4 and sys.byteorder == "little"


def plain_class(category: str) -> str:
    """The plain characters of a Unicode category, as the inside of a class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == category)


def plain_pattern(pattern: str) -> re.Pattern:
    """A split pattern with \\p{L} and \\p{N}, for plain texts."""
    for name in "LN":
        own = plain_class(name)
        pattern = re.sub(r"(\[\^?[^\]]*)\\p\{%s\}([^\]]*\])" % name, lambda m: m[1] + own + m[2], pattern)
        pattern = pattern.replace(r"\p{%s}" % name, f"[{own}]")
    return re.compile(pattern)


def byte_alphabet() -> dict[int, int]:
    """Byte value -> code point that byte-level vocabularies write it as:
    printable bytes stand for themselves, the others follow from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in keep else next(rest) for b in range(256)}


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = plain_pattern(PATTERN).findall
        self.alphabet = byte_alphabet()
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, tokenize, alphabet = self.memo, self.model.tokenize, self.alphabet
        for p in set(pieces):
            if p not in memo:
                s = p.encode("utf-8").decode("latin-1").translate(alphabet)
                memo[p] = array("I", [t.id for t in tokenize(s)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's (little-endian) order."""
        if not text:
            return b""
        if NOT_PLAIN.search(text) or any(a in text for a in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self.split(text)
        got = list(map(self.memo.get, pieces))
        if None in got:
            self._learn([p for p, g in zip(pieces, got, strict=True) if g is None])
            got = list(map(self.memo.get, pieces))
            if None in got:  # the memory was emptied meanwhile
                self._learn(pieces)
                got = list(map(self.memo.get, pieces))
        return b"".join(got)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per Python worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
