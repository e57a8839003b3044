"""Exact encoding of whole Arrow columns of texts with a byte-level ``tokenizers`` file.

As in ``chunked``, texts are cut where the tokenizer itself must cut, and the ids
of each distinct unit are asked of the library once.  Here units (a space and what
follows up to the next one) are found in the column's bytes, and those of 16 bytes
at most are looked up all at once in a hash table of arrays, whose keys are the
units' bytes themselves.  Units that are new are given to the library's model many at a
time, glued together wherever no token of the vocabulary holds the two bytes that
meet, as no merge can cross such a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunked import _BLANK, _BYTE_MARKS, _PRINTABLE, ChunkEncoder, memo, slices

_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(m): b for b, m in _BYTE_MARKS.items()}
#: By bytes: a space, other white space, what can begin a character that is not sure (control characters, some lead bytes).
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x20], _CLASS[0x09:0x0E] = 2, 1
_CLASS[[*range(9), *range(0x0E, 0x20), 0x7F, 0xC2, 0xC4, *range(0xC9, 0x100)]] = 8
#: The first 0 to 8 bytes of a word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Pieces that go to the model in one call; units of more bytes than this are not kept.
_GLUED, _LONG = 64, 256


class BatchEncoder:
    """Ids of columns of texts under ``rules``; a slice has about ``size`` bytes, and the table ``slots`` places."""

    def __init__(self, rules: ChunkEncoder, slots: int = 1 << 22, size: int = 2_000_000):
        if not rules.plain:
            raise ValueError("batches need a plain byte-level BPE file")
        if slots & (slots - 1) or slots < 2 * size:
            raise ValueError("the table needs a power of two of slots, and twice as many as a slice has bytes")
        self.rules, self.dtype, self.size = rules, rules.dtype, size
        self.slots, self.shift = slots, np.uint64(64 - slots.bit_length() + 1)
        # bytes that meet in a token, and tokens that begin with a space
        self.meet, self.blank = np.zeros((256, 256), bool), np.zeros(rules.vocabulary, bool)
        vocabulary = rules.tokenizer.get_vocab(with_added_tokens=False)
        for a, b in {pair for token in vocabulary for pair in zip(token, token[1:])}:
            if a in _BYTE_OF and b in _BYTE_OF:  # no text has other marks
                self.meet[_BYTE_OF[a], _BYTE_OF[b]] = True
        self.blank[[i for token, i in vocabulary.items() if token.startswith(_BLANK)]] = True
        self.special = [s.encode() for s in rules.specials]
        self.rest: dict[bytes, bytes] = {}
        self._empty()

    # -- the table -------------------------------------------------------
    def _empty(self) -> None:
        self.keys, self.keys_2 = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.at, self.n, self.used = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint8), np.zeros(self.slots, bool)
        self.held, self.top, self.pool = 0, 0, np.zeros(1 << 16, self.dtype)

    def _append(self, ids: np.ndarray, keep: bool = True) -> int:
        """Writes ids behind those of the table; they stay there only if they are kept."""
        at = self.top
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(at // 2 + len(ids), self.dtype)])
        self.pool[at : at + len(ids)] = ids
        self.top += len(ids) if keep else 0
        return at

    def _places(self, keys: np.ndarray, keys_2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each pair of keys, and the positions of those that were not there; they have got their slots now."""
        mixed = keys ^ keys_2 * _MIX_2
        mixed ^= mixed >> np.uint64(32)
        slot = (mixed * _MIX >> self.shift).astype(np.int64)
        left, new = np.arange(len(keys)), [np.zeros(0, np.int64)]
        at, own, own_2 = slot, keys, keys_2
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            if len(free):
                taken, first = np.unique(at[free], return_index=True)
                who = free[first]
                self.keys[taken], self.keys_2[taken] = own[who], own_2[who]
                new.append(left[who])
            stay = np.flatnonzero((self.keys[at] != own) | (self.keys_2[at] != own_2))
            left, own, own_2 = left[stay], own[stay], own_2[stay]
            at = at[stay] + 1 & self.slots - 1
            slot[left] = at
        found = np.concatenate(new)
        self.held += len(found)
        return slot, found

    def _thin(self) -> None:
        """Makes room: units that were seen once only go, or all of them if most were seen again."""
        keep = np.flatnonzero(self.used)
        keep = keep[: 0 if len(keep) > 0.4 * self.slots else None]
        keys, keys_2, n = self.keys[keep], self.keys_2[keep], self.n[keep]
        ids = self._gather(self.at[keep], n)
        self._empty()
        slot, _ = self._places(keys, keys_2)
        self.n[slot], self.at[slot] = n, np.cumsum(n, dtype=np.int64) - n
        self._append(ids)

    def _gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n, dtype=np.int64)
        return self.pool[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    # -- units -----------------------------------------------------------
    def _unit(self, unit: bytes) -> bytes:
        """Ids of one unit, piece by piece."""
        return b"".join(map(self.rules._piece, self.rules.find(unit.decode())))

    def _glued(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that begin with their only space and don't end in white space, and where each begins."""
        flat = "\0".join(self.rules.find(b"".join(units).decode())).encode()
        seen = np.frombuffer(flat, np.uint8)
        between = np.flatnonzero(seen == 0)
        cut = self.meet[seen[between - 1], seen[between + 1]]
        cut[_GLUED - 1 :: _GLUED] = True
        ends = (between - np.arange(len(between)))[cut].tolist()
        marks = flat.replace(b"\0", b"").decode("latin-1")
        for b, m in _BYTE_MARKS.items():
            if chr(b) in marks:
                marks = marks.replace(chr(b), chr(m))
        tokenize, ids = self.rules.tokenizer.model.tokenize, []
        for a, b in zip([0, *ends], [*ends, len(marks)]):
            ids += [t.id for t in tokenize(marks[a:b])]
        got = np.array(ids, self.dtype)
        begin = np.flatnonzero(self.blank[got])
        return (got, begin) if len(begin) == len(units) else None

    def _fresh(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units in some order, where each unit's begin there, and how many they are."""
        # a last byte of A0 can be white space
        plain = np.array([u[0] == 0x20 and u[-1] > 0x20 and u[-1] != 0xA0 for u in units], bool)
        at, n = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        some = np.flatnonzero(plain)
        got = self._glued([units[k] for k in some.tolist()]) if len(some) else None
        if got:
            at[some], n[some] = got[1], np.diff(got[1], append=len(got[0]))
        left = np.flatnonzero(~plain) if got else np.arange(len(units))
        own = [self._unit(units[k]) for k in left.tolist()]
        n[left] = [len(i) // self.dtype.itemsize for i in own]
        first = got[0] if got else np.zeros(0, self.dtype)
        at[left] = len(first) + np.cumsum(n[left]) - n[left]
        return np.concatenate([first, np.frombuffer(b"".join(own), self.dtype)]), at, n

    def _longer(self, units: list[bytes]) -> list[bytes]:
        """Ids of units that the table has no keys for."""
        new = [u for u in dict.fromkeys(units) if u not in self.rest]
        if not new:
            return [self.rest[u] for u in units]
        ids, at, n = self._fresh(new)
        known = {u: ids[a : a + k].tobytes() for u, a, k in zip(new, at.tolist(), n.tolist())}
        out = [self.rest[u] if u in self.rest else known[u] for u in units]
        if len(self.rest) > 50_000:
            self.rest.clear()
        self.rest |= {u: i for u, i in known.items() if len(u) <= _LONG}
        return out

    def _units(self, data: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sure texts, of which those with characters begin at ``first``, and how many of them lie before ``ends``."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(ends), np.int64)
        if self.held > 0.55 * self.slots:
            self._thin()
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        begins = data == 0x20
        begins[first] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        size = end - start
        words = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
        short = np.flatnonzero(size <= 16)
        of = size[short]
        keys = words[start[short]] & _FIRST[np.minimum(of, 8)]
        keys_2 = words[np.minimum(start[short] + 8, len(data))] & _FIRST[np.maximum(of - 8, 0)]
        slot, new = self._places(keys, keys_2)
        self.used[slot] = True
        if len(new):
            self.used[slot[new]] = False
            raw = padded.tobytes()
            ids, own, size_of = self._fresh([raw[a:b] for a, b in zip(start[short[new]].tolist(), end[short[new]].tolist())])
            self.at[slot[new]], self.n[slot[new]] = own + self._append(ids), size_of
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        at[short], n[short] = self.at[slot], self.n[slot]
        long = np.flatnonzero(size > 16)
        if len(long):
            ids = self._longer([data[a:b].tobytes() for a, b in zip(start[long].tolist(), end[long].tolist())])
            n[long] = [len(i) // self.dtype.itemsize for i in ids]
            at[long] = self._append(np.frombuffer(b"".join(ids), self.dtype), keep=False) + np.cumsum(n[long]) - n[long]
        upto = np.append(0, np.cumsum(n))
        return self._gather(at, n), upto[np.searchsorted(start, ends)]

    # -- texts -----------------------------------------------------------
    def _one(self, data: np.ndarray) -> np.ndarray:
        """Ids of one sure text, in parts that end before a space."""
        raw, a, out = data.tobytes(), 0, []
        while a < len(raw):
            b = raw.find(b" ", a + self.size)
            b = len(raw) if b < 0 else b
            out.append(self._units(data[a:b], np.zeros(1, np.int64), np.zeros(0, np.int64))[0])
            a = b
        return np.concatenate(out)

    def _slice(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = _CLASS[data]
        kinds[:-1] += kinds[1:]
        doubtful = np.unique(np.searchsorted(ends, np.flatnonzero(kinds >= 3), "right"))
        starts = np.append(0, ends[:-1])
        if self.special:
            raw = data.tobytes()
            if any(s in raw for s in self.special):
                doubtful = np.arange(len(ends))
        texts = {k: data[starts[k] : ends[k]].tobytes().decode() for k in doubtful.tolist()}
        whole = {k: np.frombuffer(self.rules.whole(t), self.dtype) for k, t in texts.items() if not self.rules.sure(t)}
        if len(ends) == 1 and not whole:
            ids = self._one(data)
            return ids, np.array([len(ids)])
        if not whole:
            return self._units(data, starts[starts < ends], ends)
        out = [whole[k] if k in whole else self._one(data[a:b]) if b > a else np.zeros(0, self.dtype) for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist()))]
        return np.concatenate(out), np.cumsum([len(i) for i in out])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges i to j of a column of texts (null: empty): i, j, their ids one after the other, and where each text's end."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + self.size, "right")) - 1)
            own = data[at[i] : at[j]]
            try:
                ids, ends = self._slice(own, at[i + 1 : j + 1] - at[i]) if len(own) else (np.zeros(0, self.dtype), np.zeros(j - i, np.int64))
            except BaseException:
                self._empty()  # slots without ids must not stay
                raise
            yield i, j, ids, ends
            i = j


class TextEncoder:
    """The same for any other file, a text at a time."""

    def __init__(self, rules: ChunkEncoder):
        self.rules, self.dtype = rules, rules.dtype

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        texts = column.to_pylist()
        for i, j in slices(texts, 2_000_000):
            own = self.rules.encode(texts[i:j])
            yield i, j, np.frombuffer(b"".join(own), self.dtype), np.cumsum([len(o) // self.dtype.itemsize for o in own])


def column_encoder(path: str) -> BatchEncoder | TextEncoder:
    """One per Python worker and file, which release() forgets as it does encoders."""

    def made() -> BatchEncoder | TextEncoder:
        rules = ChunkEncoder(path, 700_000)
        return BatchEncoder(rules) if rules.plain else TextEncoder(rules)

    return memo((path, "columns"), made)
