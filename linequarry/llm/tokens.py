"""Encoding of whole texts with the tokenizers library, remembering what each space-separated chunk becomes.

Both vocabularies split a text before merging, and no piece of that split reaches over a single space into the
chunk before it. So the ids of a text are those of its chunks, one after the other, and a chunk met before needs
no second encoding. Chunks of many texts are found, looked up and put together in numpy; a chunk of up to WIDE bytes
is its own key, so a chunk is taken for known only if all its bytes agree. Longer ones are never remembered.
Texts for which the split is not certain (runs of spaces, special tokens, unusual white space) go to the library whole.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

import numpy as np

from .common import MEMORIES

#: Chunks remembered by one Python worker, about 60 bytes each, for byte-level and for word-level files (whose workers
#: often serve other stages too); beyond, the earlier half stays, which holds the commonest.
CACHE, CACHE_WORDS = 1_600_000, 800_000
#: Bytes of a chunk that can be remembered, and how many 64-bit words that is.
WIDE, COLS = 32, 4
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_GAP = re.compile(r"\s")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> np.ndarray:
    kind = np.zeros(256, bool)
    kind[65:91] = kind[97:123] = True
    return kind


_LETTER = _letters()


def chunk_bounds(data: np.ndarray, firsts: np.ndarray, simple: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each chunk of data and the byte after it.

    firsts: where texts begin, ascending; simple: whether single line ends are chunks of their own in that text. A full
    stop or comma between a letter and white space is a chunk of its own. keep_space: a chunk carries the space before it.
    """
    n = len(data)
    space, line = data == 32, data == 10
    gap_next = np.zeros(n, bool)
    gap_next[:-1] = space[1:] | line[1:]
    stop = np.flatnonzero(((data == 46) | (data == 44)) & gap_next)
    stop = stop[stop > 0]
    left, before = data[stop - 1], data[np.maximum(stop - 2, 0)]
    latin = (before == 0xC3) & (((left >= 0x9F) & (left <= 0xB6)) | ((left >= 0xB8) & (left <= 0xBF)))
    stop = stop[_LETTER[left] | latin]
    if keep_space:
        begin = space
        begin[firsts] = True
        begin[stop] = True
        line = np.flatnonzero(line)
        if len(line):
            line = line[simple[np.searchsorted(firsts, line, side="right") - 1]]
            begin[line] = True
            begin[np.minimum(line + 1, n - 1)] = True
        start = np.flatnonzero(begin)
        return start, np.append(start[1:], n)
    gap = space | line | (data == 9) | (data == 13)
    begin = ~gap
    begin[1:] &= gap[:-1]
    begin[stop] = True
    start = np.flatnonzero(begin)
    out = np.flatnonzero(~gap[:-1] & gap[1:]) + 1  # where runs end
    if n and not gap[-1]:
        out = np.append(out, n)
    return start, np.minimum(np.append(start[1:], n), out[np.searchsorted(out, start, side="right")])


class ChunkEncoder:
    """ids of texts as little-endian 32-bit bytes. keep_space: a chunk carries the space before it (byte-level files)."""

    def __init__(self, path: str | Path, keep_space: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        self.lib = Tokenizer.from_file(str(path))
        self.lib.no_padding()
        self.lib.no_truncation()
        self.keep_space = keep_space
        self.marks = {m: self.lib.encode(m, add_special_tokens=False).ids[0] for m in (("\n\n", "\n") if keep_space else ("!",))}
        self.forget()

    def forget(self) -> None:
        """Start with nothing remembered."""
        self.most = CACHE if self.keep_space else CACHE_WORDS
        self.slots = np.full(1 << 12, -1, np.int32)
        self.keys = np.zeros((1 << 10, COLS), np.uint64)
        self.at, self.size = np.zeros(1 << 10, np.uint32), np.zeros(1 << 10, np.uint32)
        self.pool = np.zeros(1 << 12, np.uint32)
        self.n = self.used = 0

    # encoding of chunks that are not known

    def fresh(self, chunks: list[str]) -> list[np.ndarray]:
        """ids of chunks not met before. Chunks without white space inside go to the library together, parted by a mark
        that has an id of its own and that no such chunk holds."""
        out: list = [None] * len(chunks)
        groups: dict[str, list[int]] = {"\n\n": [], "\n": [], " ! ": [], "": []}
        for n, c in enumerate(chunks):
            if not self.keep_space:
                groups[" ! " if c.isalnum() else ""].append(n)
            elif c[:1] == " ":
                groups["\n\n" if len(c) > 1 and not _GAP.search(c, 1) else ""].append(n)
            else:
                groups["\n" if c and not _GAP.search(c) else ""].append(n)
        alone = groups.pop("")
        for mark, some in groups.items():
            for at in range(0, len(some), 1000):
                part = some[at : at + 1000]
                ids = np.array(self.lib.encode_batch_fast([mark.join([chunks[n] for n in part])], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.marks[mark.strip(" ")])
                if len(cuts) != len(part) - 1:
                    alone += part
                    continue
                for n, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                    out[n] = ids[a:b]
        for n, e in zip(alone, self.lib.encode_batch_fast([chunks[n] for n in alone], add_special_tokens=False)):
            out[n] = np.array(e.ids, np.uint32)
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        return "<|" not in text and not _ODD.search(text) and not (self.keep_space and "  " in text)

    # the table of known chunks: open addressing, all rows of a slice at once

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys * _MIX).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is not known."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = self._slot(keys), None
        while True:
            got = self.slots[slot]
            rows = keys if left is None else keys[left]
            same = (self.keys[got] == rows).view(np.uint32).ravel() == 0x01010101
            good = same & (got >= 0)
            if left is None:
                out[good] = got[good]
            else:
                out[left[good]] = got[good]
            on = np.flatnonzero(~same & (got >= 0))
            if not len(on):
                return out
            slot = (slot[on] + 1) & (len(self.slots) - 1)
            left = on if left is None else left[on]

    def _enter(self, first: int, last: int) -> None:
        """Put the numbers first..last into the table."""
        number = np.arange(first, last, dtype=np.int32)
        slot = self._slot(self.keys[first:last])
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            on = self.slots[slot] != number
            number, slot = number[on], (slot[on] + 1) & (len(self.slots) - 1)

    def _grow(self, more: int, ids: int) -> None:
        while self.n + more > len(self.at):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def _append(self, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(i) for i in ids], np.int64)
        total = int(sizes.sum())
        self._grow(len(ids), total)
        self.size[self.n : self.n + len(ids)] = sizes
        self.at[self.n : self.n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.n, self.used = self.n + len(ids), self.used + total

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Remember distinct chunks that are not known."""
        first = self.n
        self._append(self.fresh([c.decode("utf-8") for c in chunks]))
        self.keys[first : self.n] = keys
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            first = 0
        self._enter(first, self.n)

    def _shrink(self) -> None:
        self.n = self.most // 2
        self.used = int(self.at[self.n])
        self.keys, self.at, self.size, self.pool = self.keys[: self.n].copy(), self.at[: self.n].copy(), self.size[: self.n].copy(), self.pool[: self.used].copy()
        self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
        self._enter(0, self.n)

    def _chunked(self, raws: list[bytes], simple: np.ndarray) -> list[bytes]:
        """ids of texts that may be cut into chunks."""
        gap = b"" if self.keep_space else b" "
        joint = gap.join(raws)
        data = np.frombuffer(joint, np.uint8)
        lens = np.array([len(r) for r in raws], np.int64)
        firsts = np.cumsum(lens + len(gap)) - lens - len(gap)
        if not len(data):
            return [b""] * len(raws)
        some = lens > 0
        start, end = chunk_bounds(data, firsts[some], simple[some], self.keep_space)
        width = end - start
        view = np.frombuffer(joint + bytes(WIDE + 8), np.uint8)
        load = np.ndarray((len(data) + WIDE,), "<u8", view.data, 0, (1,))
        keys = np.empty((len(start), COLS), np.uint64)
        for k in range(COLS):
            keys[:, k] = load[start + 8 * k] & _MASK[np.clip(width - 8 * k, 0, 8)]
        short = width <= WIDE
        number = self._find(keys)
        number[~short] = -1
        if self.n > self.most:
            self._shrink()
            number = np.where(number < self.n, number, -1)
        miss = np.flatnonzero((number < 0) & short)
        if len(miss):
            new: dict[bytes, int] = {}
            for m, a, b in zip(miss.tolist(), start[miss].tolist(), end[miss].tolist()):
                new.setdefault(joint[a:b], m)
            self._learn(keys[list(new.values())], list(new))
            number[miss] = self._find(keys[miss])
        known, used = self.n, self.used
        far = np.flatnonzero(~short)
        if len(far):  # for this slice only
            long: dict[bytes, int] = {}
            number[far] = [self.n + long.setdefault(joint[a:b], len(long)) for a, b in zip(start[far].tolist(), end[far].tolist())]
            self._append(self.fresh([c.decode("utf-8") for c in long]))
        sizes = self.size[number].astype(np.int64)
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.at[number].astype(np.int64) - (upto - sizes), sizes)]
        self.n, self.used = known, used
        raw = ids.astype("<u4", copy=False).tobytes()
        cut = 4 * np.concatenate([[0], upto])[np.searchsorted(start, np.append(firsts, len(data) + 1))]
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        cut = [n for n, t in enumerate(texts) if self.plain(t)]
        for n in set(range(len(texts))).difference(cut):
            out[n] = self.whole(texts[n])
        simple = np.array([not ("\n\n" in t or " \n" in t or "\n " in t or "\t" in t or "\r" in t) for t in (texts[n] for n in cut)], bool)
        for n, raw in zip(cut, self._chunked([texts[n].encode("utf-8") for n in cut], simple)):
            out[n] = raw
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}
MEMORIES.append(_ENCODERS.clear)


def encoder(path: str, keep_space: bool, kind: type = ChunkEncoder) -> ChunkEncoder:
    """One encoder for each Python worker; another file or kind takes its place, so that one memory at most is held."""
    key = (path, keep_space, kind)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(path, keep_space)
    return _ENCODERS[key]
