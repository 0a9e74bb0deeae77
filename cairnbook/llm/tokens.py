"""Token ids of many texts through a tokenizer file, each distinct piece of text encoded once per worker.

Byte-level pre-tokenizers never look back, so a text can be cut wherever a new pre-token is bound
to begin whatever surrounds it.  Only three such places are used (see :func:`safe_cuts`); the ids of
a text are the ids of its pieces put together, and pieces repeat so often that few reach the library.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

# Distinct pieces a worker keeps; beyond it the memory starts anew.
KEPT_PIECES = 700_000
_KEY_BYTES = 24


def _classes() -> tuple[np.ndarray, ...]:
    code = np.arange(256)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    blank = ((code >= 9) & (code <= 13)) | (code == 32)
    # After a blank: a byte that cannot begin white space.  Some characters that begin with
    # C2, E1, E2 or E3 are white space, so no cut is made there.
    solid = ((code >= 33) & (code <= 126)) | ((code >= 128) & ~np.isin(code, (0xC2, 0xE1, 0xE2, 0xE3)))
    return letter, blank, solid, (code < 128) & ~letter, (code < 128) & ~blank, blank & (code != 32)


def safe_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins for certain, the starts of non-empty texts included.

    (a) at a blank before a character that is not white space, (b) where an ASCII letter is followed
    by any other ASCII character, (c) at an ASCII letter after one line end or tab that follows
    an ASCII character other than white space.
    """
    letter, blank, solid, other, dark, line = _classes()
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        cut[:n - 1] |= (data[:-1] == 32) & solid[data[1:]]
        is_letter = letter[data]
        cut[1:n] |= is_letter[:-1] & other[data[1:]]
        if n > 2:
            cut[2:n] |= is_letter[2:] & line[data[1:-1]] & dark[data[:-2]]
        # A cut must not rest on the bytes of a neighbouring text.
        inner = starts[(starts > 0) & (starts < n)]
        cut[inner - 1] = (inner - 2 >= 0) & is_letter[np.maximum(inner - 2, 0)] & other[data[inner - 1]]
        edge = np.isin(inner - 1, inner)
        cut[inner[edge] - 1] = True
        after = inner[inner + 1 < n] + 1
        cut[after] &= ~(is_letter[after] & line[data[after - 1]])
        cut[starts[:-1][starts[:-1] < starts[1:]]] = True
    return np.flatnonzero(cut[:n])


class TokenMemory:
    """Encodes blocks of texts with a tokenizer file and remembers the pieces it has met."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.parts = np.empty((0, 4), np.uint64)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.long: dict[bytes, np.ndarray] = {}

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` in one array, and the n + 1 offsets of the texts in it."""
        raw = data.tobytes()
        texts = len(starts) - 1
        if any(s in raw for s in self.special):
            return self._whole(raw, starts)
        cuts = safe_cuts(data, starts)
        if not len(cuts):
            return np.empty(0, np.uint32), np.zeros(texts + 1, np.int64)
        ends = np.append(cuts[1:], len(data))
        length = ends - cuts
        padded = np.concatenate((data, np.zeros(_KEY_BYTES + 8, np.uint8)))
        words = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
        masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
        parts = [words[cuts + 8 * j] & masks[np.clip(length - 8 * j, 0, 8)] for j in range(3)]
        parts.append(length.astype(np.uint64))
        key = np.zeros(len(cuts), np.uint64)
        for part, odd in zip(parts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
            key ^= part
            key *= np.uint64(odd)
            key ^= key >> np.uint64(31)
        far = length > _KEY_BYTES
        code, found = pd.factorize(key[~far] if far.any() else key)
        near = np.flatnonzero(~far)
        first = np.empty(len(found), np.int64)
        first[code[::-1]] = near[::-1]
        slot = self._slots(found, first, [p[first] for p in parts], cuts, ends, raw)
        picked = np.empty(len(cuts), np.int64)
        picked[near] = slot[code]
        if not all((p[near] == self.parts[picked[near], j]).all() for j, p in enumerate(parts)):
            return self._whole(raw, starts)  # two pieces of one key
        size = np.empty(len(cuts), np.int64)
        size[near] = (self.begin[1:] - self.begin[:-1])[picked[near]]
        distant = np.flatnonzero(far)
        pieces = [raw[cuts[i]:ends[i]] for i in distant]
        new = list(dict.fromkeys(p for p in pieces if p not in self.long))
        for piece, ids in zip(new, self.library([p.decode() for p in new])):
            self.long[piece] = ids
        size[distant] = [len(self.long[p]) for p in pieces]
        at = np.concatenate(([0], np.cumsum(size)))
        source = np.zeros(len(cuts), np.int64)
        source[near] = self.begin[:-1][picked[near]]
        ids = self.ids[np.minimum(np.repeat(source - at[:-1], size) + np.arange(at[-1]), max(len(self.ids) - 1, 0))] \
            if len(self.ids) else np.zeros(at[-1], np.uint32)
        for i, piece in zip(distant, pieces):
            ids[at[i]:at[i + 1]] = self.long[piece]
        if len(self.keys) > self.kept or len(self.long) > self.kept // 8:
            self._forget()
        return ids, at[np.searchsorted(cuts, starts)]

    def _slots(self, found, first, parts, cuts, ends, raw) -> np.ndarray:
        place = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == found[inside]
        slot = np.empty(len(found), np.int64)
        slot[known] = self.slot[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            got = self.library([raw[cuts[i]:ends[i]].decode() for i in first[new]])
            slot[new] = len(self.begin) - 1 + np.arange(len(new))
            order = np.argsort(found[new])
            self.keys = np.insert(self.keys, place[new][order], found[new][order])
            self.slot = np.insert(self.slot, place[new][order], slot[new][order])
            self.parts = np.concatenate((self.parts, np.stack([p[new] for p in parts], 1)))
            sizes = np.array([len(g) for g in got], np.int64)
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate([self.ids, *got])
        return slot

    def _whole(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.library([raw[a:b].decode() for a, b in zip(starts[:-1], starts[1:])])
        at = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64)
        return np.concatenate([np.empty(0, np.uint32), *got]), at
