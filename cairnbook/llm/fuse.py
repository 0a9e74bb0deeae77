"""Static binary-fuse filters in numpy: sets of 64-bit keys that answer "absent" without ever being wrong.

Every key owns three slots in three neighbouring segments; its fingerprint is the exclusive or of what they hold.
Building peels the keys: a slot that only one key owns settles that key, round by round, and the slots are then
filled in the opposite order.  About nine bits a key, and one absent key in 256 seems present.
"""

from __future__ import annotations

import math

import numpy as np

_HEAD = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _shape(count: int) -> tuple[int, int]:
    """Length of a segment and the number of segments a key may begin in."""
    if count < 2:
        return 4, 1
    length = 1 << min(18, max(2, int(math.log(count) / math.log(3.33) + 2.25)))
    room = count * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(count))
    return length, max(1, math.ceil(room / length) - 2)


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, and its fingerprint."""
    first = _mixed(keys ^ np.uint64(seed))
    second = _mixed(first + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(length - 1)
    start = ((first >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    slots = np.stack([start, (start + np.uint64(length)) ^ (second & mask),
                      (start + np.uint64(2 * length)) ^ ((second >> np.uint64(20)) & mask)]).astype(np.int64)
    return slots, (second >> np.uint64(56)).astype(np.uint8)


def _peeled(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Keys with the slot that settles each, in rounds; None if some keys hold one another."""
    count = slots.shape[1]
    owners = np.bincount(slots.ravel(), minlength=size)
    owner = np.zeros(size, np.int64)  # exclusive or of the owners: the owner itself where there is one
    for row in slots:
        np.bitwise_xor.at(owner, row, np.arange(count))
    rounds, left, single = [], count, np.flatnonzero(owners == 1)
    while len(single):
        key, at = np.unique(owner[single], return_index=True)
        rounds.append((key, single[at]))
        left -= len(key)
        touched = slots[:, key]
        np.subtract.at(owners, touched.ravel(), 1)
        for row in touched:
            np.bitwise_xor.at(owner, row, key)
        near = np.unique(touched)
        single = near[owners[near] == 1]
    return rounds if left == 0 else None


def build(keys: np.ndarray) -> bytes:
    """A filter of the given 64-bit keys; repeated keys count once, no keys give a filter that holds none."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(1, 1000):
        slots, mark = _places(keys, int(_mixed(np.array([seed], np.uint64))[0]), length, segments)
        rounds = _peeled(slots, size)
        if rounds is not None:
            break
    else:
        raise RuntimeError("no seed of a thousand settles all keys")
    held = np.zeros(size, np.uint8)
    for key, own in reversed(rounds):
        a, b, c = slots[:, key]
        held[own] = mark[key] ^ held[a] ^ held[b] ^ held[c]
    return np.array([seed, length, segments, len(keys)], np.int64).tobytes() + held.tobytes()


def may_hold(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key False if it was certainly not among those of the filter."""
    seed, length, segments, count = np.frombuffer(filter_bytes, np.int64, _HEAD).tolist()
    if not count or not len(keys):
        return np.zeros(len(keys), bool)
    held = np.frombuffer(filter_bytes, np.uint8, offset=8 * _HEAD)
    (a, b, c), mark = _places(keys.astype(np.uint64), int(_mixed(np.array([seed], np.uint64))[0]), length, segments)
    return (held[a] ^ held[b] ^ held[c]) == mark
