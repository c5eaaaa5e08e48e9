"""Whole-text encoding with the tokenizers library, at many times its speed.

The library encodes about 1 MB of text a second on one core.  Text repeats its
words, so a text is cut into units whose encodings don't depend on their
neighbours; each distinct unit is encoded once by the library, kept, and the ids
of the texts are put together from the kept ones.

Where may a text be cut?

* The pre-tokenizer of ``word_bpe_49k.json`` drops white space, and none of its
  pieces holds any: every word is a unit.
* That of ``byte_bpe_50k.json`` keeps white space.  Its pieces never cross from
  a non-space to a space, so a unit is a run of ASCII white space and the word
  after it.  A text with other white space (U+00A0 and so on) may join a run
  across such a cut, and is encoded whole.
* For any other file, texts are encoded whole.

``tests/llm`` holds the result against the library's own on random texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np

from . import kernel

_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
#: Kept units of one worker, after which it starts over: about 130 MB.
MOST_UNITS = 2_000_000


class Encoder:
    """Encodes blocks of texts; make one per worker with :func:`encoder`."""

    def __init__(self, path: str, most_units: int = MOST_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_units = most_units
        self._narrow = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        with open(path, encoding="utf-8") as f:
            pre = (json.load(f).get("pre_tokenizer") or {})
        kinds = [pre, *pre.get("pretokenizers", [])]
        if any(k.get("type") == "Split" and k.get("behavior") == "Removed" and k.get("invert") for k in kinds):
            self.unit = "word"
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.unit = "space+word"
        else:
            self.unit = "text"
        self._clear()

    def _clear(self) -> None:
        self._known = np.zeros(0, np.uint64)  # hashes of the kept units, ascending
        self._slot = np.zeros(0, np.int32)
        self._ids = np.zeros(1 << 16, np.uint16 if self._narrow else np.uint32)
        self._begin = np.zeros(1 << 12, np.int64)
        self._count = np.zeros(1 << 12, np.int32)
        self._n = self._used = 0

    def _add(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Keep new units; ``hashes`` ascend."""
        found = [np.array(e.ids, self._ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        total, n = int(count.sum()), self._n + len(found)
        while len(self._begin) < n:
            self._begin, self._count = np.resize(self._begin, 2 * len(self._begin)), np.resize(self._count, 2 * len(self._count))
        while len(self._ids) < self._used + total:
            self._ids = np.resize(self._ids, 2 * len(self._ids))
        self._begin[self._n : n] = self._used + np.cumsum(count) - count
        self._count[self._n : n] = count
        self._ids[self._used : self._used + total] = np.concatenate(found) if found else 0
        at = np.searchsorted(self._known, hashes)
        self._known = np.insert(self._known, at, hashes)
        self._slot = np.insert(self._slot, at, np.arange(self._n, n, dtype=np.int32))
        self._n, self._used = n, self._used + total

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of units, -1 for new ones."""
        if not self._n:
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self._known, hashes), self._n - 1)
        return np.where(self._known[at] == hashes, self._slot[at], -1).astype(np.int64)

    def encode_block(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in one array, and their number by text."""
        k = len(starts) - 1
        if self.unit == "text":
            return self._whole([bytes(text[starts[i] : starts[i + 1] - 1]).decode("utf-8", "replace") for i in range(k)])
        if self.unit == "space+word":
            odd = self._odd(text, starts)
            if odd.any():
                return self._mixed(text, starts, odd)
        s, e = kernel.words(text)
        if self.unit == "space+word":
            s, e = self._with_space(s, e, starts)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(k, np.int64)
        h = kernel.span_hash(text, s, e)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if self._n > self.most_units:
            self._clear()
        at = self._find(distinct)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            begin = self._n
            raw = text.tobytes()
            f = first[missing]
            self._add(distinct[missing], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[f].tolist(), e[f].tolist())])
            at[missing] = np.arange(begin, begin + len(missing))
        at = at[back]
        count = self._count[at]
        ids = self._ids[kernel.ragged(count, self._begin[at])].astype(np.uint32)
        _, offsets = kernel.per_text(starts, s)
        return ids, np.diff(np.concatenate(([0], np.cumsum(count)))[offsets])

    @staticmethod
    def _with_space(s: np.ndarray, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of white space and word; the space after a text's last word is one too."""
        _, offsets = kernel.per_text(starts, s)
        begin = np.concatenate(([0], e[:-1])) if len(e) else e
        has = np.diff(offsets) > 0
        begin[offsets[:-1][has]] = starts[:-1][has]
        last = starts[:-1].copy()
        last[has] = e[offsets[1:][has] - 1]
        end = starts[1:] - 1
        tail = last < end
        begin, stop = np.concatenate((begin, last[tail])), np.concatenate((e, end[tail]))
        order = np.argsort(begin, kind="stable")
        return begin[order], stop[order]

    @staticmethod
    def _odd(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts with white space outside ASCII."""
        odd = np.zeros(len(starts) - 1, bool)
        lead = np.flatnonzero((text == 0xC2) | (text == 0xE1) | (text == 0xE2) | (text == 0xE3))
        for i in np.unique(np.searchsorted(starts, lead, "right") - 1):
            odd[i] = bool(_OTHER_SPACE.search(bytes(text[starts[i] : starts[i + 1] - 1]).decode("utf-8", "replace")))
        return odd

    def _mixed(self, text: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for i in range(len(odd)):
            one = text[starts[i] : starts[i + 1]]
            ids, n = self._whole([bytes(one[:-1]).decode("utf-8", "replace")]) if odd[i] else self.encode_block(one, np.array([0, len(one)]))
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array([len(x) for x in found], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder of a file; kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def fingerprint(path: str) -> str:
    """A short name of a vocabulary file's content."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]
