"""Exact, cached encoding with a public tokenizer file.

Natural text repeats its words, so a text is cut where the tokenizer itself must
cut (at white space) and the ids of each distinct piece are asked of the
``tokenizers`` library's model once.  Whatever the cutting rule does not cover for sure
(special strings, control characters, scripts whose Unicode classes differ
between versions) goes to the library as a whole text, so ids are always the
library's own.

The caches hold a bounded number of pieces per Python worker and only affect speed.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

_SPACE = "\t\n\x0b\x0c\r\xa0"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
#: Characters whose class and case every Unicode version agrees on.
_UNSURE = re.compile("[^\t-\r -~ -įı-ɏ‐-‧€]")
#: How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_MARKS = {b: 0x100 + n for n, b in enumerate(sorted(set(range(0x100)) - set(_PRINTABLE)))}
_BLANK = chr(_BYTE_MARKS[0x20])
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PIECES = re.compile(
    f"{_ENDS}| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\\s{_LETTERS}{_DIGITS}]+|\\s+(?!\\S)|\\s+"
)
_WORD_PIECES = re.compile(f"{_ENDS}|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
_TWO_SPACES = tuple(["  "] + [a + " " for a in _SPACE] + [" " + a for a in _SPACE])


class Kept(dict):
    """A cache that works out what it lacks; when it is full, its entries count as old, and those used again come back."""

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.work(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = got
        return got


def marked(piece: str) -> str:
    """A pre-token as byte-level vocabularies write it."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _BLANK)
    return piece.encode().decode("latin-1").translate(_BYTE_MARKS)


class ChunkEncoder:
    """Ids of texts under the ``tokenizers`` file at ``path``, as packed arrays."""

    def __init__(self, path: str, max_entries: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if vocabulary <= 65_536 else np.dtype("<u4")
        self.code = "H" if vocabulary <= 65_536 else "I"
        self.vocabulary = vocabulary
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
            self.kind = "byte"
        elif [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            x["type"] for x in before.get("pretokenizers", [])
        ] == ["Split", "ByteLevel"]:
            self.kind = "word"
        else:
            self.kind = "whole"
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        model = spec["model"]
        #: Whether the ids of a pre-token are what the merges alone make of its bytes.
        self.plain = self.kind == "byte" and model["type"] == "BPE" and not any(model.get(k) for k in odd)
        self.pieces = Kept(self._piece, max_entries)
        self.chunks = Kept(self._chunk, max_entries)
        self.find = (_WORD_PIECES if self.kind == "word" else _BYTE_PIECES).findall

    # -- whole texts -----------------------------------------------------
    def whole(self, text: str) -> bytes:
        """The library's ids of one whole text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def sure(self, text: str) -> bool:
        """Whether cutting at white space surely gives the library's ids."""
        if self.kind == "whole" or _UNSURE.search(text) or any(s in text for s in self.specials):
            return False
        return self.kind == "word" or not any(p in text for p in _TWO_SPACES)

    def cut(self, text: str) -> list[str]:
        """The chunks of a text that is sure(); each stands for its own ids."""
        if self.kind == "word":
            return text.lower().split()
        first, *rest = text.split(" ")
        return [f" {first}", *rest] if first else rest

    def _of_chunk(self, chunk: str) -> str:
        """Source text of a chunk.  Byte level: all but the first follow a space; the first is marked by one."""
        if self.kind == "word":
            return chunk
        return chunk[1:] if chunk[:1] == " " else f" {chunk}"

    def _piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(marked(piece))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A chunk of one piece is kept as a chunk alone, and a chunk's first piece is a chunk itself, so a word is kept once."""
        found = self.find(self._of_chunk(chunk))
        if len(found) == 1:
            return self._piece(found[0])
        out = [self.pieces[p] for p in found[1:]]
        for p in found[:1]:
            own = p if self.kind == "word" else p[1:] if p[0] == " " else ""
            out.insert(0, self.chunks[own] if own else self.pieces[p])
        return b"".join(out)

    def one(self, text: str | None) -> bytes:
        """Packed ids (``self.dtype``) of a text; null counts as empty."""
        if not text:
            return b""
        return b"".join(map(self.chunks.__getitem__, self.cut(text))) if self.sure(text) else self.whole(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(t) for t in texts]


_made: dict[tuple, object] = {}


def memo(key: tuple, make: Callable):
    """What ``make`` gives, once per Python worker and key."""
    if key not in _made:
        _made[key] = make()
        trim()  # reading the file takes as much as it leaves
    return _made[key]


def encoder(path: str, max_entries: int = 349_525) -> ChunkEncoder:
    """One encoder per Python worker and file.  A dict of one entry more than 2/3 * 2**19 takes twice the table."""
    return memo((path, max_entries), lambda: ChunkEncoder(path, max_entries))


def release() -> None:
    """Forgets the worker's encoders and their caches; a stage that encodes nothing calls it, as workers go on from stage to stage."""
    _made.clear()


def trim() -> None:
    """Gives memory that nothing holds back to the system, where the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def afresh(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that encodes nothing: what the worker's earlier stages hold goes before it, what it has held goes behind it.

    Idle workers count beside an executor's heap, which can be full in the next stage.
    """

    def task(batches: Iterator) -> Iterator:
        release()
        trim()
        yield from run(batches)
        trim()

    return task


def slices(texts: list[str | None], chars: int = 4_000_000):
    """Consecutive ranges of texts with about so many characters each, one text at least."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        if j > i and n + len(t or "") > chars:
            yield i, j
            i, n = j, 0
        n += len(t or "")
    if len(texts) > i:
        yield i, len(texts)
