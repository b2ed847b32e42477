"""Token ids of whole texts with a public tokenizer, as little-endian uint32 bytes.

Nearly all words of a text have been met before, so a Python worker keeps the
ids of words, over all its tasks, and has the tokenizer work on new ones only. A text
is cut only where the pre-tokenizer cuts too, so the ids are those of the
whole text:

* ``byte``: a word takes one blank before it along. White space of one or two
  characters between words is cut anywhere; a text with a longer run, or with
  two at its end, is cut only before a blank that follows a non-blank.
* ``word``: the normaliser drops white space, so any blank or newline is a cut.

A text that holds the string of a special token goes through the whole
tokenizer, which gives that token's id, as the library does by default. A new word of Latin-1 letters is one pre-token, so it goes to the BPE model
straight; all else goes through the whole tokenizer.
"""

from __future__ import annotations

import re
import string
import sys
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from .worker import kept

#: Words that a Python worker keeps, half of them recent; about 200 bytes each.
CACHE_WORDS = 1_000_000
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= )")
_TAIL = ".,;:!?)\"'|"
#: What byte-level BPE cuts from the letters before it and keeps together.
_MARKS = string.punctuation


def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE shows each byte as: itself
    if it prints in Latin-1, else the next free one from U+0100 on."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    rest = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + i) for i, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Recent(dict):
    """Ids by word; a word that is not there is learnt."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Words:
    """Ids by word: the recent ones, and those before them until these fill up."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn
        self.recent, self.older = Recent(learn), {}

    def age(self) -> None:
        self.older, self.recent = self.recent, Recent(self.learn)


class Encoder:
    """``encode(text)`` gives a text's ids as uint32 bytes."""

    def __init__(self, path: str, kind: str, cache_words: int = CACHE_WORDS):
        if kind not in ("byte", "word"):
            raise ValueError(f"kind must be 'byte' or 'word', not {kind!r}")
        self.tok, self.kind, self.cache_words = load(path), kind, cache_words
        self.tokenize, self.letters = self.tok.model.tokenize, byte_letters()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = self.letters[32]
        self.tail = _TAIL if kind == "word" else _MARKS
        self.bare, self.spaced = Words(self._bare), Words(self._spaced)  # spaced: of " " + the word
        self.hard: list[str] = []  # words of ``spaced`` that are still to go through the whole tokenizer
        #: By id, whether the token begins with a blank.
        self.blank = np.zeros(1 + max(self.tok.get_vocab().values(), default=0), dtype=bool)
        self.blank[[i for t, i in self.tok.get_vocab().items() if t.startswith(self.letters[32])]] = True

    def encode(self, text: str) -> bytes:
        lower = text.lower()
        for x in self.added:
            if x in text or x in lower:
                return self._whole([text])[0]
        for words in (self.bare, self.spaced):
            if len(words.recent) > self.cache_words // 2:
                words.age()
        if self.kind == "word":  # the normaliser lowers letters one by one; A-Z beforehand makes fewer words
            low = text.lower() if text.isascii() else text.encode().lower().decode()
            return b"".join(map(self.bare.recent.__getitem__, low.replace("\n", " ").split(" ")))
        line = text.replace("\n", " ")
        # white space but the blank is not printable, so that a printable line needs no search character by character
        if ("   " in line or line.endswith("  ")) if line.isprintable() else _LONG_RUN.search(text):
            return b"".join(map(self.bare.recent.__getitem__, _CUT.split(text)))
        first, *rest = text.replace("\n", " \n").split(" ")  # a newline stays with the word behind it
        known = self.spaced.recent
        ids = b"".join(map(known.__getitem__, rest))
        if self.hard:
            known.update(zip(self.hard, self._joined(self.hard)))
            self.hard = []
            ids = b"".join(map(known.__getitem__, rest))
        return self.bare.recent[first] + ids

    def _bare(self, word: str) -> bytes:
        ids = self.bare.older.get(word) or self._plain(word, self.bare.recent, "", "")
        return self._whole([word])[0] if ids is None else ids

    def _spaced(self, word: str) -> bytes:
        ids = self.spaced.older.get(word)
        if ids:
            return ids
        if word.isascii():  # most new words: letters, or letters and a tail of marks, without the calls below
            if word.isalpha():
                return _bytes([t.id for t in self.tokenize(self.mark + word)])
            body = word.rstrip(self.tail)
            if body.isalpha():
                return self.spaced.recent[body] + self.bare.recent[word[len(body):]]
        if word.startswith("\n"):
            return self.bare.recent["\n"] + self.bare.recent[word[1:]]
        ids = self._plain(word, self.spaced.recent, " ", self.mark)
        if ids is None:  # the hard words of a text are learnt together
            self.hard.append(word)
            return b""
        return ids

    def _plain(self, word: str, known: Recent, before: str, mark: str) -> bytes | None:
        """Ids of ``before``, which the model shows as ``mark``, and a word of Latin-1 letters with or without a tail; None of others."""
        body = word if word.isalpha() else word.rstrip(self.tail)
        if not body.isalpha() or not (body.isascii() or max(body) < "Ā"):
            return None  # beyond Latin-1, lowering may give a mark that belongs to the tail
        if body is not word:
            return known[body] + self.bare.recent[word[len(body):]]
        if not word.isascii():
            lower = word.lower() if self.kind == "word" else word
            mark, word = "", (before + lower).encode().decode("latin-1").translate(self.letters)
        return _bytes([t.id for t in self.tokenize(mark + word)])

    def _joined(self, words: list[str]) -> list[bytes]:
        """Of each word with a blank before it, encoded as one text, which is cut where a token begins with a blank:
        the pre-tokenizer cuts there too, and no other token of a word without white space does."""
        if all(x.split() == [x] for x in words):
            ids = self._whole([" " + " ".join(words)])[0]
            at = 4 * np.flatnonzero(self.blank[np.frombuffer(ids, dtype=np.uint32)])
            if len(at) == len(words):
                return [ids[lo:hi] for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(ids)])]
        return self._whole([" " + x for x in words])

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [_bytes(e.ids) for e in got]


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of this Python worker."""
    return kept(Encoder, path, kind)
