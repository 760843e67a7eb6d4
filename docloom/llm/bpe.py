"""Byte-level BPE ids of whole columns of text, with the tokenizers library.

Most words of a corpus come again and again, so a worker keeps what the library
said for each stretch of text between places where no token can cross: before
white space, after it, and before a mark that follows a letter. Stretches are
found and looked up in numpy; only new ones are encoded. ``tests/llm`` compares
the ids with the library's for whole texts. The cache is cleared at MAX_UNITS.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from . import textarrays as ta

MAX_UNITS = 1_000_000
#: White space outside ASCII, in UTF-8.
_FAR_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Units:
    """What has been said of stretches of text so far: their ids, by 64-bit hashes of their bytes.

    ``encode_units`` says it of new ones.
    """

    def __init__(self):
        self._clear(1 << 16)

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _clear(self, slots: int) -> None:
        self.key = np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.int64)
        self.count = np.zeros(slots, np.int32)
        self.store = np.zeros(1 << 16, np.uint32)
        self.used = self.units = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        mask = len(self.key) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        out = np.full(len(h), -1)
        left = np.arange(len(h))
        while len(left):
            k = self.key[slot[left]]
            same = k == h[left]
            out[left[same]] = slot[left[same]]
            left = left[~same & (k != 0)]
            slot[left] = (slot[left] + 1) & mask
        return out

    def _put(self, h: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        if (self.units + len(h)) * 2 > len(self.key):
            old = np.flatnonzero(self.key)
            keep = self.key[old], self.at[old], self.count[old]
            size = len(self.key)
            while (self.units + len(h)) * 2 > size:
                size *= 2
            self.key, self.at, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
            self.units = 0
            self._put(*keep)
        mask = len(self.key) - 1
        slot, left = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            self.key[slot[free]] = h[free]
            mine = self.key[slot[left]] == h[left]
            done = left[mine]
            self.at[slot[done]], self.count[slot[done]] = at[done], count[done]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & mask
        self.units += len(h)

    def _learn(self, data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        found = self.encode_units([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        count = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((x for f in found for x in f), np.uint32, int(count.sum()))
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(max(len(flat), self.used), np.uint32)])
        self.store[self.used : self.used + len(flat)] = flat
        self._put(h, self.used + np.cumsum(count) - count, count)
        self.used += len(flat)

    def look_up(self, buf: np.ndarray, offs: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows that start at offs, whose stretches start where cut is set, and where each row starts."""
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        h = ta.Spans(buf).hash(start, end)
        h[h == 0] = 1
        slot = self._slots(h)
        if (new := slot < 0).any():
            if self.units > MAX_UNITS:
                self._clear(1 << 16)
                new = np.ones(len(h), bool)
            uniq, first = np.unique(h[new], return_index=True)
            first = np.flatnonzero(new)[first]
            self._learn(buf.tobytes(), start[first], end[first], uniq)
            slot = self._slots(h)
        count = self.count[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], count)
        return self.store[take], total[np.searchsorted(start, offs)]


class Encoder(Units):
    """``ids(column)``: all ids of the rows on end, and where each row starts.

    As the library by default, a special token's string in a text is that token;
    with ``plain`` it is text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if not (plain and t.special)]
        #: Rows that have any of these are encoded whole.
        self.whole = re.compile(b"|".join([_FAR_BLANK.pattern, *map(re.escape, added)]))
        self.model = self.tok.model
        self.chars = _byte_chars()
        self.single = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+").fullmatch
        super().__init__()

    def _encode(self, text: bytes) -> list[int]:
        s = text.decode()
        if self.single(s) and not self.whole.search(text):
            return [t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, text)))]
        return self.tok.encode(s, add_special_tokens=False).ids

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        return [self._encode(u) for u in units]

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = ta.raw(col)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        data = buf.tobytes()
        blank = ta.WS[buf]
        prev, nxt = np.empty_like(blank), np.empty_like(blank)
        prev[0], prev[1:] = False, blank[:-1]
        nxt[-1], nxt[:-1] = True, blank[1:]
        nxt[offs[1:][offs[1:] > 0] - 1] = True  # a row's last run has no last blank of its own
        letter = _LETTER[buf]
        latin = np.flatnonzero(buf[:-1] == 0xC3) + 1
        letter[latin[(buf[latin] != 0x97) & (buf[latin] != 0xB7)]] = True
        last = blank & ~nxt
        cut = (blank & ~prev) | last
        cut[1:] |= (last & (buf != 32))[:-1] | (_MARK[buf[1:]] & letter[:-1])
        full = offs[:-1] < offs[1:]
        cut[offs[:-1][full]] = True
        whole = np.zeros(len(offs) - 1, bool)
        for m in self.whole.finditer(data):
            whole[np.searchsorted(offs, m.start(), "right") - 1] = True
        for r in np.flatnonzero(whole):
            cut[offs[r] + 1 : offs[r + 1]] = False
        return self.look_up(buf, offs, cut)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each worker process and vocabulary, with what it has learned so far."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
