"""Streaming BPE encoding and decoding for vocabularies with an end-of-word
suffix.

Encoder: a transducer that reads a word symbol by symbol. The BPE encoding of a
prefix is fixed by its last token: it is the one token that ends there and is
stable next to the last token of the shorter prefix before it. Two tokens are
stable neighbours if BPE leaves their joined symbols as just these two. So the
state at a position needs the states of the last ``lookahead`` positions only,
where the merge list's sufficient lookahead is the length of its longest token.
A token is emitted once it lies on the paths of all these states, for then no
later symbol can change it; memory stays constant however long the word is.

Decoder: ``TextDecoder``, a state machine that takes ids one by one or in lists
and keeps constant memory. It gives text: bytes pass an incremental UTF-8
decoder, so that a character cut between tokens comes out when its last byte
arrives, and the end-of-word suffix becomes a space. With ``spelled`` it gives
the library's form for files without a decoder, the tokens as the vocabulary
spells them, with a space between any two; its state is whether one came before.

Words recur, so each Python worker remembers the ids of short words it met; the
memory is emptied when it holds too many.

Edge cases: a null or empty text has no ids and decodes to the empty text;
strings of added tokens in a text become their ids, as in the library; rows are
independent, so repeated rows give equal results; an empty table no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, text_of
from .tokens import NOT_PLAIN, byte_alphabet, plain_pattern

_WORDS = 400_000
_PAIRS = 2_000_000
_LONG = 64
_CHUNK = 4096


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.added).items()}
        end = len(self.suffix)
        # symbols are single characters; the last one of a word carries the suffix
        self.inner = {t: i for t, i in self.vocab.items() if not (end and t.endswith(self.suffix))}
        self.final = {t[:-end]: i for t, i in self.vocab.items() if end and t.endswith(self.suffix) and len(t) > end}
        self.symbols = {i: (t, None) for t, i in self.inner.items()} | {i: (t[:-1], t[-1]) for t, i in self.final.items()}
        self.lookahead = max(map(len, [*self.inner, *self.final]))
        self.longest: dict[str, int] = {}  # last two symbols -> length of the longest token that ends so
        for t in [*self.inner, *self.final]:
            self.longest[t[-2:]] = max(len(t), self.longest.get(t[-2:], 1))
        self.alphabet = byte_alphabet()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.library = Tokenizer.from_file(path)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = plain_pattern(pattern).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def _apart(self, token: int) -> list[int]:
        text, last = self.symbols[token]
        return [self.inner[c] for c in text] + ([] if last is None else [self.final[last]])

    def stable(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left right`` as they are."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            parts = self._apart(left) + self._apart(right)
            while len(parts) > 1:
                best = min(((self.rank.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
                if best[0][0] == 1 << 60:
                    break
                parts[best[1]:best[1] + 2] = [best[0][1]]
            known = self.pairs[key] = parts == [left, right]
        return known

    def transduce(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of one word, each as soon as it is stable."""
        source = iter(symbols)
        ahead = next(source, None)
        if ahead is None:
            return
        window, base = "", 0       # the last symbols, and the position of the first of them
        last, begin = {0: -1}, {0: 0}  # state by position: last token and where it begins
        pos, done = 0, 0           # positions read, positions emitted
        while ahead is not None:
            symbol, ahead = ahead, next(source, None)
            window += symbol
            pos += 1
            known = self.final if ahead is None and self.suffix else self.inner
            for size in range(min(self.lookahead, pos - done), 0, -1):
                token = known.get(window[pos - size - base:pos - base])
                if token is not None:
                    before = last[pos - size]
                    if before is None:
                        continue
                    if before < 0 or self.stable(before, token):
                        last[pos], begin[pos] = token, pos - size
                        break
            else:
                last[pos], begin[pos] = None, pos
            if pos - done >= 4 * self.lookahead and ahead is not None:
                done = yield from self._settle(last, begin, done, pos)
                cut = done - base
                if cut > 0:
                    window, base = window[cut:], done
        out = []
        while pos > done:
            out.append(last[pos])
            pos = begin[pos]
        yield from reversed(out)

    def _settle(self, last: dict, begin: dict, done: int, pos: int) -> Iterator[int]:
        """Emits the tokens that all states of the last ``lookahead`` positions
        share, forgets what is behind them and returns the new begin."""
        live = {p for p in range(max(done, pos - self.lookahead), pos + 1) if last[p] is not None}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(begin[far])
        common = at = live.pop()
        out = []
        while at > done:
            out.append(last[at])
            at = begin[at]
        yield from reversed(out)
        for p in [p for p in last if p < common]:
            del last[p], begin[p]
        return common

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece whose characters stand for bytes. A word that fits the
        lookahead is read to its end before anything could be emitted, so the
        states are filled in at once."""
        n = len(piece)
        if n > self.lookahead:
            return tuple(self.transduce(piece))
        final, inner, stable, longest = self.final if self.suffix else self.inner, self.inner, self.stable, self.longest
        pairs = self.pairs
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for pos in range(1, n + 1):
            known = final if pos == n else inner
            for at in range(max(pos - longest.get(piece[max(pos - 2, 0):pos], 1), 0), pos):
                token = known.get(piece[at:pos])
                if token is not None:
                    before = last[at]
                    if before is None:
                        continue
                    if before >= 0:
                        ok = pairs.get(before << 32 | token)
                        if ok is None:
                            ok = stable(before, token)
                        if not ok:
                            continue
                    last[pos], begin[pos] = token, at
                    break
            else:
                last[pos] = None
        out, pos = [], n
        while pos:
            out.append(last[pos])
            pos = begin[pos]
        return tuple(out[::-1])

    def _plain_words(self, pieces: list[str]) -> list[tuple[int, ...]]:
        words, alphabet = self.words, self.alphabet
        got = list(map(words.get, pieces))
        if None in got:
            if len(words) >= _WORDS:
                words.clear()
            for i, ids in enumerate(got):
                if ids is None:
                    piece = pieces[i]
                    ids = words.get(piece)
                    if ids is None:
                        ids = self.word(piece.encode("utf-8").decode("latin-1").translate(alphabet))
                        if len(piece) <= _LONG:
                            words[piece] = ids
                    got[i] = ids
        return got

    def chunks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in lists, word group by word group."""
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        for part in parts:
            if part in self.added:
                yield [self.added[part]]
            elif NOT_PLAIN.search(part):
                normal = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    yield list(self.word(piece))
            else:
                pieces = self.split(part.lower())
                for i in range(0, len(pieces), _CHUNK):
                    yield list(chain.from_iterable(self._plain_words(pieces[i:i + _CHUNK])))

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text, as a stream."""
        return chain.from_iterable(self.chunks(text))


class TextDecoder:
    """ids -> text; ``feed`` returns what is certain after an id, ``feed_all`` after a list of ids."""

    def __init__(self, bpe: WordBpe, spelled: bool = False):
        self.bpe, self.spelled, self.begun = bpe, spelled, False
        self.back = {} if spelled else {c: bytes([b]) for b, c in bpe.alphabet.items()}
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token_id: int) -> str:
        token = self.bpe.token[token_id]
        if self.spelled:
            out = " " + token if self.begun else token
            self.begun = True
            return out
        if token in self.bpe.added:
            return self.utf8.decode(b"", True) + token
        ends = bool(self.bpe.suffix) and token.endswith(self.bpe.suffix)
        body = token[:-len(self.bpe.suffix)] if ends else token
        out = self.utf8.decode(b"".join(self.back[ord(c)] for c in body), ends)
        return out + " " if ends else out

    def feed_all(self, ids: list[int]) -> str:
        if not self.spelled or not ids:
            return "".join(map(self.feed, ids))
        # one state change for the list: what follows its first id is the same from any state
        return self.feed(ids[0]) + "".join([" " + self.bpe.token[i] for i in ids[1:]])

    def close(self) -> str:
        return self.utf8.decode(b"", True)


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) per document."""

    def run(batches):
        bpe = word_bpe(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [list(bpe.encode(t)) for t in pdf["text"]]})

    src = docs.select(col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per document, ids and
    decoded text taken chunk by chunk."""

    def run(batches):
        bpe = word_bpe(tokenizer)
        number = {i: str(i) for i in bpe.token}.__getitem__
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids_sha, text_sha, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, TextDecoder(bpe, spelled=True)
                for chunk in filter(None, bpe.chunks(text)):
                    if n:
                        ids_sha.update(b" ")
                    ids_sha.update(" ".join(map(number, chunk)).encode())
                    text_sha.update(decoder.feed_all(chunk).encode())
                    n += len(chunk)
                text_sha.update(decoder.close().encode())
                rows.append((doc, n, ids_sha.hexdigest(), text_sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    out = src.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
