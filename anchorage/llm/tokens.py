"""Token ids of whole texts, encoded word by word."""

from __future__ import annotations

import codecs
import functools
import os
import re
import string
from collections.abc import Iterable

from .common import LEFT

# Unicode white space, as the tokenizers' patterns read it.
_SPACE = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_OTHER = re.compile(f"[{_SPACE.replace(' ', '', 1)}]".replace("\t-\r", "\t\x0b-\r"))

# Byte-level vocabularies show bytes as characters, a fixed rule: printable ones as
# they are, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SHOWN = "".join(_OTHERS.get(b, chr(b)) for b in range(256))

# Marks after a letter are a piece of their own; no contraction ends in one.
_MARKS = string.punctuation

#: Words whose ids a worker remembers, about 200 bytes each.
REMEMBERED = 700_000


class _Known(dict):
    """Ids of words, worked out when they are first asked for.

    When it is full the words become the older half, and come back from there as they are used.
    """

    def __init__(self, new, most: int):
        super().__init__()
        self._new, self._most, self._older = new, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self._older.pop(word, None)
        if ids is None:
            ids = self._new(word)
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > self._most:
            self._older = dict(self)
            self.clear()


class Encoder:
    """Encodes texts with a public tokenizer and remembers the ids of words.

    The tokenizers split a text before they merge, never inside a run without
    white space, so the ids of a text are those of its words in a row.  A word
    keeps the space before it where the vocabulary has words with a space.  A
    new word is split by the tokenizer's own rules and merged by its own model;
    letters alone, with marks after them, need no rules to be split.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._own = own = Tokenizer.from_file(path)
        # tokens that are cut out of a text before its words are split, in any case
        added = [t.content for t in own.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)", re.IGNORECASE)
        self.size = own.get_vocab_size()
        self._model, self._split, self._normal = own.model, own.pre_tokenizer.pre_tokenize_str, own.normalizer
        self._known = _Known(self._new, remembered)
        self._bytes = [i.to_bytes(4, "little") for i in range(self.size)]
        self._spaced = own.encode("a b").tokens != own.encode("a").tokens + own.encode("b").tokens
        self._blank = self._split(" a")[0][0].removesuffix("a") if self._spaced else ""
        self._lower = self._normal is not None and self._normal.normalize_str("Ab") == "ab"
        # letters that are looked at one by one come out as str.lower has them, so words of them do
        letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
        self._lowers = self._lower and all(self._normal.normalize_str(c) == c.lower() for c in letters)

    def _letters(self, word: str) -> bytes:
        own = self._bytes
        return b"".join([own[x.id] for x in self._model.tokenize(word)])

    def _merge(self, parts: Iterable[str]) -> bytes:
        own, tokenize = self._bytes, self._model.tokenize
        return b"".join([own[x.id] for p in parts for x in tokenize(p)])

    def _of(self, word: str) -> bytes:
        return self._known[word]

    def _new(self, word: str) -> bytes:
        if word.isalpha():
            if self._lowers and (low := word.lower()) != word and max(word + low) < "\u0250":
                return self._of(low)
            if word.isascii():  # most words
                return self._letters(word.lower() if self._lower else word)
        if not word:
            return b""
        letters = word[1:] if self._spaced and word[0] == " " else word
        if letters.isalpha():
            blank = self._blank if len(letters) < len(word) else ""
            if letters.isascii():
                return self._letters(blank + (letters.lower() if self._lower else letters))
            if max(letters) < "\u0250":
                own = letters.lower() if self._lowers else self._normal.normalize_str(letters) if self._normal else letters
                if own.isalpha() and max(own) < "\u0250":
                    return self._letters(blank + codecs.charmap_decode(own.encode(), "strict", _SHOWN)[0])
        elif word[0] == "\n" and len(word) > 1 and not word[1].isspace():
            return self._of("\n") + self._of(word[1:])
        else:
            core = word.rstrip(_MARKS)
            if len(core) < len(word) and core[-1:].isalpha():
                return self._of(core) + self._of(word[len(core) :])
        return self._merge(p for p, _ in self._split(self._normal.normalize_str(word) if self._normal else word))

    def _words(self, text: str) -> list[str]:
        if not self._spaced:
            return text.replace("\n", " ").split(" ")
        if self._uneven(text):
            return _RUNS.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    @staticmethod
    def _uneven(text: str) -> bool:
        """Whether white space is more than single blanks and line ends between words."""
        twice = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        return twice or "\0" in text or text[:1] in " \n" or text[-1:] in " \n" or bool(_OTHER.search(text))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A text that holds an added token of the vocabulary is left to the tokenizer as a whole.
        """
        self._known.age()
        ids, added, words = self._known.__getitem__, self._added.search, self._words
        return [self._plain(x) if added(x) else b"".join(map(ids, words(x))) for x in texts]

    def _plain(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self._own.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


LEFT.append(encoder.cache_clear)
