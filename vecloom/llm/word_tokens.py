"""Exact and fast ids of the word_bpe_49k tokenizer, by remembering words.

That tokenizer lowers its text, drops white space, and treats runs of letters, single digits and runs of other characters
on their own. So ids of a text are the ids of its words in turn, and words that were seen before need no merging. Words of
ASCII and Latin-1 letters are cut here; anything else goes to the tokenizer itself, as a whole stretch without white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer, normalizers

#: The tokenizer's word pattern for texts of these characters, and the mark of a word's last token.
SAFE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
GAP = re.compile(r"[ \t\n\r]+")
SPECIAL, LAST = "<|", "</w>"
#: Words kept at most, twice over, and the longest that are; about 60 MB each.
CACHED, LONGEST = 400_000, 64
#: Characters of texts whose words are looked up together.
TOGETHER = 1 << 18


class Words:
    def __init__(self, path: str, cached: int = CACHED):
        self.whole, self.bare, self.cached = Tokenizer.from_file(path), Tokenizer.from_file(path), cached
        self.bare.normalizer = normalizers.Sequence([])
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith(LAST)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        old, new = self.old, self.new
        plain, rest = [], []
        for w in words:
            if (ids := old.get(w)) is not None:
                new[w] = ids
            elif SPECIAL not in w and SAFE.fullmatch(w):
                plain.append(w)
            else:
                rest.append(w)
        if plain:
            ids = np.array(self.bare.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.nonzero(self.last[ids])[0] + 1
            if len(ends) == len(plain):
                flat, begin = ids.astype("<u4").tobytes(), 0
                for w, end in zip(plain, (ends * 4).tolist()):
                    new[w], begin = flat[begin:end], end
            else:
                rest += plain
        if rest:
            for w, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                new[w] = np.array(e.ids, "<u4").tobytes()

    def _cut(self, text: str) -> list[str]:
        if SPECIAL not in text and SAFE.fullmatch(text):
            return WORD.findall(text.lower())
        words = []
        for part in GAP.split(text):
            if SPECIAL not in part and SAFE.fullmatch(part):
                words += WORD.findall(part.lower())
            elif part:
                words.append(part)
        return words

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self._cut(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        here = set().union(*group)
        if missing := here.difference(self.new):
            if len(self.new) + len(missing) > self.cached:
                self.old, self.new, missing = self.new, {}, here
            self._learn(missing)
        get = self.new.__getitem__
        for words in group:
            yield np.frombuffer(b"".join(map(get, words)), "<u4")
        for w in [w for w in here if len(w) > LONGEST]:
            del self.new[w]


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """One for each Python worker, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]
