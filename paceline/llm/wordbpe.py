"""Ids of whole texts from a tokenizer that drops white space, through a bounded table of words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np

#: Words the table of one Python worker may hold; it is emptied when full.
TABLE_WORDS = 900_000
#: Words looked up at once, and new words encoded in one call.
SLICE, CALL = 100_000, 500
#: Characters of text that are encoded together.
GROUP_CHARS = 1_000_000
MARK = "\x00"
ENDS = b".,;:!?"


class WordEncoder:
    """Encodes texts word by word; equal words are encoded once while the table holds them.

    Right for tokenizers that lower the case of letters, separate at white space and drop it,
    which is tried when the file is read. Texts are cut at the strings of the tokenizer's added
    tokens first, as the library does: they are found as they stand, whatever is around them,
    and only what lies between is lowered and looked up.
    """

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (k, t) for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values()):
            raise ValueError(f"{path}: added tokens depend on the text around them")
        self.added = {content: k for content, (k, _) in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        # A lowered word may read like an added token without being one.
        self.tokenizer.encode_special_tokens = True
        if self._whole(" A\n b\t") != self._whole("a") + self._whole("b") or len(self._whole(MARK)) != 1:
            raise ValueError(f"{path}: white space or case is part of the tokens")
        self.mark, self.table_words = self._whole(MARK)[0], table_words
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self._empty()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start = np.zeros(self.table_words + 3 * SLICE, np.int64)
        self.length = np.zeros(self.table_words + 3 * SLICE, np.int32)
        self.ids, self.used = np.zeros(4 * SLICE, np.uint32), 0

    def _marked(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: the words go into one text, with a mark between them."""
        if any(MARK in w for w in words):
            return [np.array(self._whole(w), np.uint32) for w in words]
        ids = np.array(self._whole(f" {MARK} ".join(words)), np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return [ids[a:b] for a, b in zip([0, *(marks + 1)], [*marks, len(ids)])]

    def _letters(self, words: list[str]) -> list[np.ndarray]:
        """The same for words of letters, each of which has one id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return self._marked(words)
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _add(self, words: list[bytes], found: list[np.ndarray]) -> None:
        if not words:
            return
        first = len(self.place)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        end = self.used + int(sizes.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(end, len(self.ids)), np.uint32)])
        self.ids[self.used : end] = np.concatenate(found)
        self.start[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.length[first : first + len(found)] = sizes
        self.used = end
        self.place.update(zip(words, range(first, first + len(words))))

    def _ids(self, word: bytes) -> np.ndarray:
        k = self.place[word]
        return self.ids[self.start[k] : self.start[k] + self.length[k]]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words; of letters with end marks after them, the two parts."""
        stems: dict[bytes, None] = {}
        parts = []
        added = [w for w in words if w.startswith(b" ")]
        self._add(added, [np.array([self.added[w[1:].decode()]], np.uint32) for w in added])
        for word in words:
            if word.startswith(b" "):
                continue
            stem = word.rstrip(ENDS)
            if stem != word and stem.decode().isalpha():
                parts.append((word, stem))
            else:
                stem = word
            if stem not in self.place:
                stems[stem] = None
        letters, others = [], []
        for stem in stems:
            (letters if stem.decode().isalpha() else others).append(stem)
        for group, encode in ((letters, self._letters), (others, self._marked)):
            for i in range(0, len(group), CALL):
                part = group[i : i + CALL]
                self._add(part, encode([w.decode() for w in part]))
        for tail in {word[len(stem) :] for word, stem in parts}:
            if tail not in self.place:
                self._add([tail], self._marked([tail.decode()]))
        self._add([w for w, _ in parts], [np.concatenate([self._ids(s), self._ids(w[len(s) :])]) for w, s in parts])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of words in a row, and how many each word has."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = dict.fromkeys(words[i] for i in missing)
            if len(self.place) + 2 * len(new) > self.table_words:
                self._empty()
                new = dict.fromkeys(words)
                missing = range(len(words))
            self._learn(list(new))
            at[missing] = [self.place[words[i]] for i in missing]
        sizes = self.length[at].astype(np.int64)
        ends = np.cumsum(sizes)
        where = np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[where], sizes

    def _split(self, text: str) -> list[bytes]:
        """The words of a text, lowered; an added token is one with a blank before it, as no word has."""
        if not any(a in text for a in self.added):
            return text.encode().lower().split()
        out: list[bytes] = []
        for i, part in enumerate(self.cuts.split(text)):
            out += [b" " + part.encode()] if i % 2 else part.encode().lower().split()
        return out

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; none for null."""
        words: list[bytes] = []
        bounds = [0]
        for text in texts:
            words += self._split(text or "")
            bounds.append(len(words))
        parts = [self._words(words[i : i + SLICE]) for i in range(0, len(words), SLICE)]
        if not parts:
            return [np.zeros(0, np.uint32)] * (len(bounds) - 1)
        ids = np.concatenate([p[0] for p in parts])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])[bounds]
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def stream(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """``(*key, ids)`` for rows ``(*key, text)``, some texts at a time."""
        keys, texts, size = [], [], 0
        for *key, text in rows:
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from ((*k, ids) for k, ids in zip(keys, self.encode(texts)))
                keys, texts, size = [], [], 0
        yield from ((*k, ids) for k, ids in zip(keys, self.encode(texts)))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
