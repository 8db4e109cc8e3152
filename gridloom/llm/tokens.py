"""Tokenizer access inside Python workers: segments are encoded once and looked up again.

A text is cut where no token can cross: after a non-space character that is followed by an
ASCII blank. Each distinct segment goes through the tokenizer in batches; a text's
tokens are those of its segments in order. A segment that is not known yet is cut again, behind a letter that ASCII punctuation or a digit
follows, as no token holds both; so the tokenizer sees a word once and not once for every mark behind it. The memo of a worker is bounded.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from gridloom.llm.text import by_bytes

BLANKS = " \\t\\n\\r"
_WITH_SPACE = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
_NO_SPACE = re.compile(f"[^{BLANKS}]+")
_ODD_SPACE = re.compile(f"[^\\S{BLANKS}]")
_SAFE_CUT = re.compile(f"(?<=\\S)(?=[{BLANKS}])")
_WORD_END = re.compile(r"(?<=[^\W\d_])(?=[!-@\[-`{-~])")
#: White space to Python that tokenizers may take for something else.
_OWN_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: A worker forgets segments, and parts of segments, beyond so many of each or so many characters.
MEMO_SEGMENTS, MEMO_PARTS, MEMO_CHARS = 800_000, 1_000_000, 12_000_000
#: Parts, and characters, of one call of the tokenizer; a single part may be longer.
ENCODE_BATCH, ENCODE_CHARS = 4096, 1 << 18


def segments_with_space(text: str) -> list[str]:
    """Segments of a byte-level tokenizer: blanks belong to the word behind them.

    Other white space than ASCII blanks joins runs of blanks, so such texts are cut only behind
    a character that is no white space at all.
    """
    if _ODD_SPACE.search(text):
        return [s for s in _SAFE_CUT.split(text) if s]
    return _WITH_SPACE.findall(text)


def segments_without_space(text: str) -> list[str]:
    """Segments of a tokenizer that drops white space."""
    return text.split() if _OWN_SPACE.search(text) is None else _NO_SPACE.findall(text)


class SegmentMemo:
    """Encoded segments of one worker. ``split`` turns the ids of many parts and their counts into what is stored for each, ``join`` what is stored for parts into that of the whole.

    Most parts are a word of letters, with a blank before it where blanks count (``spaced``). They go to the tokenizer in one text, as it makes a word of each again; where it finds another
    number of words, and for all other parts, each part is a text of its own.
    """

    def __init__(self, path: str, split: Callable[[np.ndarray, np.ndarray], list], join: Callable[[list], object], spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.marks = [m for m in "<[|{(#_" if all(m in t for t in special)][:1]  # a character that every special string has
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("ABCXYZ") == "abcxyz"
        self.split, self.join, self.spaced = split, join, spaced
        self._forget()
        self.parts: dict[str, object] = {}
        self.part_chars = 0

    def _forget(self) -> None:
        self.places, self.chars = {}, 0

    def plain(self, text: str) -> str:
        """The text, in lower case if that gives the same ids and saves segments."""
        if self.lowers and text.isascii() and not self.special.search(low := text.lower()):
            return low
        return text

    def _cut(self, segment: str) -> list[str]:
        """Parts of a segment that are encoded on their own; a special string is never cut."""
        if (not self.marks or self.marks[0] in segment) and self.special.search(segment):
            return [segment]
        return _WORD_END.split(segment)

    def _is_word(self, part: str) -> bool:
        return part[0] == " " and part[1:].isalpha()

    def _encode(self, parts: list[str]) -> None:
        """Store the ids of parts that are not known yet."""
        words = list(filter(self._is_word if self.spaced else str.isalpha, parts))
        if words:
            found = self.tokenizer.encode(("" if self.spaced else " ").join(words), add_special_tokens=False)
            numbers = found.word_ids
            if numbers and None not in numbers and numbers[-1] == len(words) - 1:
                counts = np.bincount(numbers, minlength=len(words))
                if counts.all():
                    self.parts.update(zip(words, self.split(np.asarray(found.ids), counts)))
                    parts = [p for p in parts if p not in self.parts] if len(words) < len(parts) else []
        if parts:
            done = [d.ids for d in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            counts = np.fromiter(map(len, done), np.int64, len(done))
            self.parts.update(zip(parts, self.split(np.fromiter(chain.from_iterable(done), np.int64, int(counts.sum())), counts)))

    def _learn(self, new: set[str]) -> None:
        """Store what belongs to new segments. Segments of letters are a part of their own."""
        whole = list(filter(str.isalpha, new))
        mixed = list(new.difference(whole))
        cut = list(map(self._cut, mixed))
        wanted = set(chain.from_iterable(cut))
        wanted.update(whole)
        todo = wanted.difference(self.parts)
        if todo and (len(self.parts) + len(todo) > MEMO_PARTS or self.part_chars > MEMO_CHARS):
            self.parts, self.part_chars, todo = {}, 0, wanted
        todo = list(todo)
        sizes = list(map(len, todo))
        for at in range(0, len(todo), ENCODE_BATCH):
            for low, high in by_bytes(sizes[at:at + ENCODE_BATCH], ENCODE_CHARS):
                self._encode(todo[at + low:at + high])
        self.part_chars += sum(sizes)
        self.chars += sum(map(len, new))
        found, join = self.parts, self.join
        self.places.update(zip(whole, map(found.__getitem__, whole)))
        self.places.update(zip(mixed, [found[parts[0]] if len(parts) == 1 else join([found[p] for p in parts]) for parts in cut]))

    def of(self, texts: list[list[str]]) -> list[Iterator]:
        """For each list of segments what is stored for them, in order. Good until the next call."""
        if len(self.places) > MEMO_SEGMENTS or self.chars > MEMO_CHARS:
            self._forget()
        new = set(chain.from_iterable(texts)).difference(self.places)
        if new:
            collects = gc.isenabled()
            gc.disable()  # the many short lists made here hold no cycles
            try:
                self._learn(new)
            finally:
                if collects:
                    gc.enable()
        value = self.places.__getitem__
        return [map(value, segments) for segments in texts]


_MEMOS: dict[tuple, SegmentMemo] = {}


def memo(path: str, kind: str, split: Callable[[np.ndarray, np.ndarray], list], join: Callable[[list], object], spaced: bool) -> SegmentMemo:
    """The memo of this worker process, shared by the tasks that it runs."""
    if (path, kind) not in _MEMOS:
        _MEMOS[path, kind] = SegmentMemo(path, split, join, spaced)
    return _MEMOS[path, kind]
