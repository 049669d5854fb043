"""Byte-pair encoding of whole texts by a tokenizer file, with distinct pieces encoded once.

Byte-level BPE never merges across the pieces its pre-tokenizer cuts, so a batch is cut into
pieces by array operations, each piece that is not in a worker's table goes through the
tokenizers library's model once, and the ids are laid out again. Texts with characters beyond U+024F (where the class of a
character could depend on the library's Unicode version), texts that hold a special token's
string, and other kinds of tokenizer go through the library whole. The result is always what
``encode_batch(texts, add_special_tokens=False)`` gives.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np

from .textkernel import U64, mix, slabs

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
#: Pieces kept between batches (a power of two); beyond it, those not used since the last time go.
CACHE = 1 << 18
#: Bytes of a short piece, which is kept as two integers.
SHORT = 15
#: Bytes of text that are laid out at once.
SLAB = 1 << 19
#: Pieces that are written in stand-ins at once, and what is between them meanwhile (no byte's stand-in).
PIECES, _MARK = 4096, "\u2603"
#: Texts that go to the library in one call: its result objects take about 150 bytes a token.
WHOLE = 64


def _class_of(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)[0]
    if ch in "\t\n\x0b\x0c\r\x20\x85\xa0":
        return _SPACE
    return _LETTER if kind == "L" else _DIGIT if kind == "N" else _OTHER


_CLASS = np.array([_class_of(c) for c in range(0x250)], np.uint8)
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


def piece_starts(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the texts that begin at ``first`` in ``buf``.

    The pattern is the public byte-level one: contractions, runs of letters, of digits and of
    other signs with one blank before them, and white space.
    """
    n = len(buf)
    cls = _CLASS[np.minimum(buf, 0x7F)]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        code = ((buf[lead] & 0x1F).astype(np.int32) << 6) | (buf[lead + 1] & 0x3F)
        cls[lead] = cls[lead + 1] = _CLASS[code]
    opens = np.zeros(n + 1, bool)
    opens[first[first < n]] = True
    opens[n] = True
    starts = opens[:n].copy()
    starts[1:] |= cls[1:] != cls[:-1]
    is_char = (buf & 0xC0) != 0x80
    space = cls == _SPACE
    # The last character of a run of white space stands apart when a non-space follows it in the text.
    next_char = np.zeros(n, bool)  # the character is the last of its run, and the text goes on
    next_char[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    last = np.flatnonzero(next_char)
    back = last - ((buf[last] & 0xC0) == 0x80)  # its first byte
    starts[back] = True
    # A single blank joins what follows.
    blank = back[buf[back] == 0x20]
    starts[blank + 1] = False
    # Contractions: an apostrophe that is a piece of its own, then s t m d, or re ve ll.
    quote = np.flatnonzero((buf[:-1] == 0x27) & starts[:-1]) if n > 1 else np.zeros(0, np.int64)
    quote = quote[starts[quote + 1] & ~opens[quote + 1]]
    if len(quote):
        a = buf[quote + 1]
        b = np.where(quote + 2 < n, buf[np.minimum(quote + 2, n - 1)], 0)
        b[opens[np.minimum(quote + 2, n)]] = 0
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        for hit, width in ((quote[one], 2), (quote[two], 3)):
            starts[hit + 1] = False
            after = hit + width
            after = after[after < n]
            inside = after[~opens[after] & (cls[after] == _LETTER) & is_char[after]]
            starts[inside] = True
    return np.flatnonzero(starts)


class PieceTable:
    """Short pieces and their ids in arrays: a hash table with open addressing, looked up for a whole slab at once.

    A piece of up to ``SHORT`` bytes is its first eight bytes and the others with the length, so
    two pieces are equal exactly if both integers are.
    """

    def __init__(self, size: int = CACHE) -> None:
        self.size, self.mask = size, 2 * size - 1
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(2 * self.size, -1, np.int32)
        self.low, self.high = np.empty(self.size, np.uint64), np.empty(self.size, np.uint64)
        self.at, self.n = np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
        self.used = np.zeros(self.size, bool)
        self.held, self.flat, self.end = 0, np.empty(2 * self.size, np.uint32), 0

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        out = np.full(len(low), -1, np.int32)
        slot = (mix(low ^ (high * U64(0x9E3779B97F4A7C15))) & U64(self.mask)).astype(np.int64)
        entry = self.slot[slot]
        same = (entry >= 0) & (self.low[entry] == low) & (self.high[entry] == high)
        out[same] = entry[same]
        left = np.flatnonzero((entry >= 0) & ~same)
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            entry = self.slot[slot[left]]
            same = (entry >= 0) & (self.low[entry] == low[left]) & (self.high[entry] == high[left])
            out[left[same]] = entry[same]
            left = left[(entry >= 0) & ~same]
        return out

    def room(self, n: int) -> None:
        """Make room for n more pieces: what was not used since the last time goes; all goes if that is too little."""
        if self.held + n <= self.size:
            return
        kept = np.flatnonzero(self.used[: self.held])
        low, high, at, size, flat = self.low[kept], self.high[kept], self.at[kept], self.n[kept], self.flat
        self._clear()
        if len(kept) + n <= self.size // 2:
            begin = np.cumsum(size) - size
            self.add(low, high, size, flat[np.repeat(at - begin, size) + np.arange(int(size.sum()))])

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New, distinct pieces with their ids laid one after another."""
        n, total = len(low), len(ids)
        if self.end + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(len(self.flat), total), np.uint32)))
        new = np.arange(self.held, self.held + n)
        self.low[new], self.high[new], self.n[new] = low, high, size
        self.at[new] = self.end + np.cumsum(size) - size
        self.flat[self.end : self.end + total] = ids
        self.held, self.end = self.held + n, self.end + total
        slot = (mix(low ^ (high * U64(0x9E3779B97F4A7C15))) & U64(self.mask)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            free = left[self.slot[slot[left]] < 0]
            self.slot[slot[free]] = new[free]  # of several pieces at one slot the last stays
            left = left[self.slot[slot[left]] != new[left]]
            slot[left] = (slot[left] + 1) & self.mask


class Encoder:
    """ids of texts by one tokenizer file. One instance serves a Python worker."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.by_piece = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        alphabet = _byte_alphabet()
        self.table = [alphabet[b] for b in range(256)]
        self.map = {b: alphabet[b] for b in range(256)}
        self.pieces = PieceTable()
        self.model = self.tokenizer.model

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, the ids), by the tokenizer's model alone."""
        number, ids, tokenize = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], self.model.tokenize
        for i in range(0, len(pieces), PIECES):
            some = _MARK.join(p.decode("latin-1") for p in pieces[i : i + PIECES]).translate(self.map).split(_MARK)
            got = [[t.id for t in tokenize(p)] for p in some]
            number.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(number[-1].sum())))
        return np.concatenate(number), np.concatenate(ids)

    def _entries(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, number, ids): each piece's ids are ``number`` values of ``ids`` from ``place``."""
        words = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(16), 0, (1,))
        low = words[start] & _LOW[np.minimum(size, 8)]
        high = np.where(size > 8, words[np.minimum(start + 8, len(raw))] & _LOW[np.clip(size - 8, 0, 7)], U64(0)) | (np.minimum(size, SHORT + 1).astype(np.uint64) << U64(56))
        short = size <= SHORT
        entry = self.pieces.find(low, high)
        miss = np.flatnonzero((entry < 0) & short)
        if len(miss):
            order = miss[np.lexsort((low[miss], high[miss]))]
            new = np.concatenate(([True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])))
            some = order[new]
            for i in range(0, len(some), self.pieces.size // 4):
                part = some[i : i + self.pieces.size // 4]
                number, ids = self._pieces([raw[a : a + n] for a, n in zip(start[part].tolist(), size[part].tolist(), strict=True)])
                self.pieces.room(len(part))
                self.pieces.add(low[part], high[part], number, ids)
            entry = self.pieces.find(low, high)
            if (lost := np.flatnonzero((entry < 0) & short)).size:  # more pieces than the table holds
                return self._directly(raw, start, size, lost, entry)
        return self._directly(raw, start, size, np.flatnonzero(~short), entry)

    def _directly(self, raw: bytes, start: np.ndarray, size: np.ndarray, some: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_entries``: the pieces ``some`` and all that have no entry go to the tokenizer, equal ones once."""
        table = self.pieces
        got = np.maximum(entry, 0)
        table.used[got] = True
        at, n = table.at[got], table.n[got].astype(np.int64)
        some = np.flatnonzero(entry < 0) if len(some) else some
        if not len(some):
            return at, n, table.flat
        texts = [raw[a : a + m] for a, m in zip(start[some].tolist(), size[some].tolist(), strict=True)]
        code = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        number, ids = self._pieces(list(code))
        place = table.end + np.cumsum(number) - number
        which = np.fromiter((code[t] for t in texts), np.int64, len(texts))
        at[some], n[some] = place[which], number[which]
        return at, n, np.concatenate((table.flat[: table.end], ids))

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), WHOLE):
            got = self.tokenizer.encode_batch([t.decode("utf-8", "surrogatepass") for t in texts[i : i + WHOLE]], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in got]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids (uint32) of every text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        odd, plain = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            simple = self.by_piece and not any(s in t for s in self.specials) and (t.isascii() or not len(np.flatnonzero(np.frombuffer(t, np.uint8) > 0xC9)))
            (plain if simple else odd).append(i)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        for first, part in slabs([texts[i] for i in plain], SLAB):
            raw = b"".join(part)
            buf = np.frombuffer(raw, np.uint8)
            begin = np.concatenate(([0], np.cumsum([len(t) for t in part])))
            start = piece_starts(buf, begin[:-1])
            end = np.append(start[1:], len(buf))
            at, n, flat = self._entries(raw, start, end - start)
            total = np.concatenate(([0], np.cumsum(n)))
            laid = flat[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
            cut = total[np.searchsorted(start, begin)]
            for k in range(len(part)):
                out[plain[first + k]] = laid[cut[k] : cut[k + 1]]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
