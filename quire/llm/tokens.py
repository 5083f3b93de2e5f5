"""Token ids of many texts: every distinct piece between safe cuts is encoded once, the rest is looked up.

A text is cut where white space follows a visible ASCII character, and where
ASCII punctuation follows an ASCII letter; the byte-level pattern of the
vocabulary never joins characters across such a place, nor looks across it, so
the ids of the parts make up the ids of the text. Tokens added to the vocabulary
("<|endoftext|>") are parts of their own wherever a text holds them, as the
library has it by default: it splits at them before anything else.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import text as T

#: Distinct pieces that a worker remembers; beyond them it starts anew.
REMEMBER = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _VISIBLE & ~_LETTER
_MARK[48:58] = False


def _byte_letters() -> dict[int, str]:
    """The letters for bytes of byte-level vocabularies: visible Latin-1 characters stand for themselves, the others are moved beyond 255 in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """encode(data, offsets) -> (ids, offsets of ids). One for each process and vocabulary."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for t in added):
            raise ValueError("added tokens that take in or ask for their surroundings cannot be cut out of a text")
        self.added = {t.content for t in added}
        longest = sorted((x.encode() for x in self.added), key=len, reverse=True)
        self.find = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self._forget()

    def _forget(self):
        self.keys = np.empty(0, np.uint64)
        self.rank = np.empty(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        before, here = data[:-1], data[1:]
        cut = (_VISIBLE[before] & _SPACE[here]) | (_LETTER[before] & _MARK[here])
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        cut[inner - 1] = True
        for lo, hi in self._added_spans(data, offsets):
            cut[lo : hi - 1] = False
            cut[[x - 1 for x in (lo, hi) if 0 < x < len(data)]] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        ends = np.append(starts[1:], len(data))
        hashed = T.span_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        entry = self._entries(data, distinct, starts[first], ends[first])[which]
        sizes = self.starts[entry + 1] - self.starts[entry]
        ids = self.flat[T.ranges(self.starts[entry], sizes)]
        ends_of = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends_of[np.searchsorted(starts, offsets)]

    def _added_spans(self, data, offsets) -> list[tuple[int, int]]:
        """Where added tokens stand, each within one text."""
        if not self.find or not self.find.search(raw := data.tobytes()):
            return []
        return [m.span() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.find.finditer(raw, lo, hi)]

    def _entries(self, data, keys, starts, ends) -> np.ndarray:
        """Entry of each distinct piece; new ones are encoded."""
        if len(self.keys) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            found = self._encode([raw[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            n = len(self.starts) - 1
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in found])])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.uint32)])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.rank = np.insert(self.rank, at[new], n + np.arange(len(new)))
            at = np.searchsorted(self.keys, keys)
        return self.rank[at]

    def _encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part. A space and Latin letters are a single piece before merging, so the model alone is asked for them."""
        out: list[list[int] | None] = [None] * len(parts)
        rest = []
        model = self.tokenizer.model
        for i, x in enumerate(parts):
            word = x[1:] if x[0] == " " else x
            if word.isalpha() and max(word) <= "\xff" and x not in self.added:
                out[i] = [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out
