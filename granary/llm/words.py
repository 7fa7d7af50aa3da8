"""Words of whole Arrow batches of texts: lower-cased A-Z, digits and every non-ASCII character, as 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed at once; bounds the scratch memory for a text of any length.
STRETCH = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = True
IN_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def weights(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # text k is data[bounds[k]:bounds[k + 1]]
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # words of text k are offsets[k]:offsets[k + 1]

    def words(self, k: int) -> list[bytes]:
        """The words of text k themselves."""
        lo, hi = self.offsets[k], self.offsets[k + 1]
        base = int(self.bounds[k])
        held = LOWER[self.data[base : int(self.bounds[k + 1])]].tobytes()
        return [held[s - base : e - base] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(texts: pa.Array) -> Words:
    data, bounds = buffers(texts)
    starts, ends, hashes = [], [], []
    weight = weights(64, 7)
    at = 0
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    while at < len(data):
        stop = min(len(data), at + STRETCH)
        while stop < len(data) and IN_WORD[data[stop]] and IN_WORD[data[stop - 1]] and not cut[stop]:
            more = data[stop : stop + 4096]
            gap = np.flatnonzero(~IN_WORD[more] | cut[stop : stop + len(more)])
            stop += int(gap[0]) if len(gap) else len(more)
        part = data[at:stop]
        inside = IN_WORD[part]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | cut[at:stop]))
        if len(s):
            after = np.empty(len(part), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            e = np.flatnonzero(inside & (~after | cut[at + 1 : stop + 1])) + 1
            length = e - s
            if (longest := int(length.max())) > len(weight):
                weight = weights(longest, 7)
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            place = np.arange(int(length.sum())) - np.repeat(first, length)
            value = (LOWER[part[inside]].astype(U) + U(1)) * weight[place]
            hashes.append(mix(np.add.reduceat(value, first)))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    none = np.zeros(0, np.int64)
    begin = np.concatenate(starts) if starts else none
    return Words(data, bounds, begin, np.concatenate(ends) if ends else none, np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(begin, bounds))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words that begins at a word; runs over the end are left out."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    weight = weights(length, 11)
    out = hashes[:n] * weight[0]
    for j in range(1, length):
        out += hashes[j : j + n] * weight[j]
    return mix(out)
