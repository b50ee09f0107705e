"""Token ids of whole texts through a cache of their pieces.

A text is cut before each blank that a non-blank character follows. A tokenizer whose pattern
lets a piece begin with one blank and never run across such a place gives the same ids for the
parts as for the whole. Equal parts are encoded once for each worker process: a part is looked up
by a hash of its bytes, and every hit is compared with the bytes that were encoded. The cache is
bounded in bytes.

A tokenizer's added tokens are parts of their own. The blanks before one end the part before it,
as they end the segment that the tokenizer cuts there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from veritable.llm.shared import EIGHT_MASKS, SHORT_SPAN, eights, gathered, spared, span_hashes as part_hashes

#: Bytes of parts and ids a worker keeps; past that it starts over, which costs time and changes nothing.
CACHE_BYTES = 128 << 20
#: Parts that are turned into ids at once.
GROUP_PARTS = 1 << 18

# Bytes that may begin a white-space character (ASCII and control ones, and lead bytes of U+0085,
# U+00A0, U+1680, U+2000 and up, U+3000): no cut before a blank that one of them follows.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def added_pattern(tokens: list[str]) -> re.Pattern[bytes] | None:
    """What finds added tokens in bytes, the longest one at a place; None without any."""
    longest_first = sorted((t.encode() for t in tokens), key=lambda t: (-len(t), t))
    return re.compile(b"|".join(re.escape(t) for t in longest_first)) if tokens else None


def part_starts(raw: np.ndarray, offsets: np.ndarray, added: re.Pattern[bytes] | None = None) -> np.ndarray:
    """Byte starts of the parts of all rows."""
    starts = np.zeros(len(raw), bool)
    starts[:-1] = (raw[:-1] == 0x20) & ~_MAY_BE_SPACE[raw[1:]]
    last = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= len(raw))] - 1
    starts[last] = False
    if added:
        data, row_ends = raw.tobytes(), offsets.tolist()
        spans = np.array([m.span() for a, b in zip(row_ends, row_ends[1:]) for m in added.finditer(data, a, b)], np.int64).reshape(-1, 2)
        starts[spans[:, 0][spans[:, 0] > 0] - 1] = False
        cuts = spans.ravel()
        starts[cuts[cuts < len(raw)]] = True
    starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(starts)


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with more values after the used ones, at least doubled where it is too short."""
    if used + len(more) > len(held):
        held = np.concatenate([held, np.zeros(max(len(held), used + len(more) - len(held)), held.dtype)])
    held[used : used + len(more)] = more
    return held


class PartIds:
    """Ids of parts, remembered by the hash of their bytes and checked by the bytes."""

    def __init__(self, encode: Callable[[list[str]], list], added: list[str] | None = None) -> None:
        self.encode = encode
        self.added = added_pattern(added or [])
        self._clear()

    def _clear(self) -> None:
        # sorted hashes with the place of their part, in runs of falling size that are merged as they grow
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.parts = self.used = self.used_bytes = 0
        self.at, self.count, self.byte_at, self.byte_count = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.ids, self.bytes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8)  # eight bytes stay unused

    @property
    def held_bytes(self) -> int:
        return 4 * self.used + self.used_bytes + 48 * self.parts

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the parts of these hashes are kept; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, places in self.runs:
            near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out = np.where(keys[near] == hashes, places[near], out)
        return out

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        new = self._encoded(raw, starts, ends)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.int32, int(counts.sum()))
        sizes = ends - starts
        self.ids = _grown(self.ids, self.used, flat)
        self.bytes = _grown(self.bytes, self.used_bytes, spared(raw[gathered(starts, sizes)]))
        places = self.parts + np.arange(len(new))
        for name, values in (
            ("at", self.used + np.cumsum(counts) - counts), ("count", counts), ("byte_at", self.used_bytes + np.cumsum(sizes) - sizes), ("byte_count", sizes),
        ):
            setattr(self, name, _grown(getattr(self, name), self.parts, values))
        self.used, self.used_bytes, self.parts = self.used + len(flat), self.used_bytes + int(sizes.sum()), self.parts + len(new)
        keys = hashes
        held = places
        while self.runs and len(self.runs[-1][0]) < 2 * len(keys):
            more, at = self.runs.pop()
            keys, held = np.concatenate([more, keys]), np.concatenate([at, held])
            order = np.argsort(keys)
            keys, held = keys[order], held[order]
        self.runs.append((keys, held))
        return places

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
        data = raw.tobytes()
        return self.encode([data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])

    def _same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each part has the bytes of the one that is kept in its place."""
        sizes, kept = ends - starts, self.byte_at[place]
        same = sizes == self.byte_count[place]
        here, there = eights(spared(raw)), eights(self.bytes)
        at, done = np.flatnonzero(same & (sizes <= SHORT_SPAN)), 0
        while len(at):
            left = sizes[at] - done
            equal = (here[starts[at] + done] ^ there[kept[at] + done]) & EIGHT_MASKS[np.minimum(left, 8)] == 0
            same[at[~equal]] = False
            at, done = at[equal & (left > 8)], done + 8
        for k in np.flatnonzero(same & (sizes > SHORT_SPAN)).tolist():
            same[k] = np.array_equal(raw[starts[k] : ends[k]], self.bytes[kept[k] : kept[k] + sizes[k]])
        return same

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts one after the other, and how many each part has."""
        raw, starts, ends = raw[starts[0] : ends[-1]], starts - starts[0], ends - starts[0]
        unique, first, inverse = np.unique(part_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if self.held_bytes > CACHE_BYTES:
            self._clear()
        place = self._places(unique)
        new = place < 0
        if new.any():
            place[new] = self._learn(raw, unique[new], starts[first[new]], ends[first[new]])
        place = place[inverse]
        counts = self.count[place]
        other = np.flatnonzero(~self._same(raw, starts, ends, place))
        if not len(other):
            return self.ids[gathered(self.at[place], counts)], counts
        own = dict(zip(other.tolist(), self._encoded(raw, starts[other], ends[other])))
        each = [np.asarray(own[k], np.int32) if k in own else self.ids[self.at[p] : self.at[p] + self.count[p]] for k, p in enumerate(place.tolist())]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def token_runs(raw: np.ndarray, offsets: np.ndarray, parts: PartIds) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, ids, whether they are its last) in order; a long row comes in several runs."""
    starts = part_starts(raw, offsets, parts.added)
    row_parts = np.searchsorted(starts, offsets)
    ends = np.append(starts[1:], len(raw))
    row = 0
    for low in range(0, max(len(starts), 1), GROUP_PARTS):
        high = min(low + GROUP_PARTS, len(starts))
        ids, counts = parts.of(raw, starts[low:high], ends[low:high]) if high > low else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        upto = np.concatenate([[0], np.cumsum(counts)])
        while row < len(offsets) - 1:
            a, b = max(int(row_parts[row]), low), min(int(row_parts[row + 1]), high)
            last = row_parts[row + 1] <= high
            yield row, ids[upto[max(a - low, 0)] : upto[max(b - low, 0)]] if b > a else ids[:0], bool(last)
            if not last:
                break
            row += 1
