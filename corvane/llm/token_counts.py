"""Token counts at every prefix of a text, by dynamic programming.

In byte-pair encoding, the encoding of a prefix without its last token is the
encoding of the shorter prefix.  So one token is stored for each position, the
last one of the prefix that ends there: the only vocabulary entry that ends
there and may follow the last token of the prefix before it.  The entries that end
at each byte come from one walk of an Aho-Corasick automaton over the vocabulary, so
a table takes time in proportion to its pre-token.  The count is then
one more than the count at the position before that token, and every question
about truncation or budgets is a lookup.

Pre-tokens don't interact, so tables are kept for distinct pre-tokens and summed.  A
cut changes the last pre-token alone: a run of one class of characters is then the
run's own prefix, white space at the end is one pre-token, an ending such as
"'ll" falls apart, and so does a special string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunked import _BYTE_PIECES, _ENDS, ChunkEncoder, Kept, marked
from .common import small_batches, table

#: Unicode white space, as the library's patterns take it.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN, _RUN_BEFORE, _ENDING = re.compile(f"[{_SPACES}]+"), re.compile(f"[^{_SPACES}]"), re.compile(f"(?:{_ENDS})$")
#: Pre-tokens of more characters than this are not kept in the caches.
_LONG = 256

Piece = tuple[int, int, bool]


class PrefixCounts:
    """Exact token counts at all prefixes, for a byte-level ``tokenizers`` file."""

    def __init__(self, path: str, max_entries: int = 500_000):
        self.rules = ChunkEncoder(path)
        if self.rules.kind != "byte":
            raise ValueError("prefix counts need a byte-level BPE file")
        if any(t.lstrip or t.rstrip or t.single_word for t in self.rules.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("prefix counts need special strings that stand for themselves alone")
        self.tokenize = self.rules.tokenizer.model.tokenize
        self.split = self.rules.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(map(re.escape, sorted(self.rules.specials, key=len, reverse=True))) or "(?!)")
        self.known = ahocorasick.Automaton()
        for token in self.rules.tokenizer.get_vocab(with_added_tokens=False):
            self.known.add_word(token, token)
        self.known.make_automaton()
        self.follows = Kept(self._may_follow, max_entries)
        self.tables = Kept(self._table, max_entries)
        self.chunks = Kept(self._chunk, max_entries)
        self.long: tuple[str, np.ndarray] = ("", np.zeros(1, np.int32))

    # -- the tables ------------------------------------------------------
    def _may_follow(self, pair: tuple[str, str]) -> bool:
        before, token = pair
        return [t.value for t in self.tokenize(before + token)] == ([before, token] if before else [token])

    def prefixes(self, piece: str) -> bytes | np.ndarray:
        """Counts at all byte prefixes (0 to all) of one pre-token."""
        if len(piece) <= _LONG:
            return self.tables[piece]
        if self.long[0] != piece:
            self.long = (piece, self._table(piece))
        return self.long[1]

    def _table(self, piece: str) -> bytes | np.ndarray:
        marks, follows = marked(piece), self.follows
        last, counts, done = [""], [0], 0
        for end, token in self.known.iter(marks):
            if end < done:  # the prefix that ends here is settled
                continue
            start = end + 1 - len(token)
            if start <= done and follows[last[start], token]:
                last.append(token)
                counts.append(counts[start] + 1)
                done += 1
        if done < len(marks):  # pragma: no cover - every byte is in the vocabulary
            raise ValueError(f"no token ends at byte {done + 1} of {piece[:80]!r}")
        return bytes(counts) if len(counts) < 256 else np.array(counts, np.int32)

    def _chunk(self, chunk: str) -> int:
        return sum([int(self.prefixes(p)[-1]) for p in _BYTE_PIECES.findall(self.rules._of_chunk(chunk))])

    def _counted(self, chunk: str) -> int:
        return self.chunks[chunk] if len(chunk) <= _LONG else self._chunk(chunk)

    def pieces(self, text: str) -> list[Piece]:
        """(start, end, special) of the special strings and the library's own pre-tokens of any text."""
        out, at = [], 0
        for m in [*self.special.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                out += [(at + a, at + b, False) for _, (a, b) in self.split(text[at:end])]
            if m:
                out.append((end, m.end(), True))
                at = m.end()
        return out

    def _of_piece(self, text: str, piece: Piece) -> int:
        start, end, special = piece
        return 1 if special else int(self.prefixes(text[start:end])[-1])

    # -- questions about texts -------------------------------------------
    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty."""
        if not text:
            return 0
        if not self.rules.sure(text):
            return sum(self._of_piece(text, p) for p in self.pieces(text))
        return sum(map(self._counted, self.rules.cut(text)))

    def at(self, text: str | None, chars: int) -> int:
        """Tokens of the first ``chars`` characters, exactly as if they were a text of their own."""
        if not text or chars <= 0:
            return 0
        if chars >= len(text):
            return self.count(text)
        if not self.rules.sure(text):
            pieces = self.pieces(text)
            i = next(k for k, p in enumerate(pieces) if p[1] >= chars)
            return self._cut(text, pieces, i, sum(self._of_piece(text, p) for p in pieces[:i]), chars)
        start, end = max(0, text.rfind(" ", 0, chars)), text.find(" ", chars)
        n = sum(map(self._counted, self.rules.cut(text[:start]))) if start else 0
        source = text[start : end if end >= 0 else len(text)]
        pieces = [(*m.span(), False) for m in _BYTE_PIECES.finditer(source)]
        i = next(k for k, p in enumerate(pieces) if p[1] >= chars - start)
        return n + self._cut(source, pieces, i, sum(self._of_piece(source, p) for p in pieces[:i]), chars - start)

    def _cut(self, text: str, pieces: list[Piece], i: int, before: int, k: int) -> int:
        """Tokens of ``text[:k]``, which ends in piece ``i``; the pieces before have ``before``."""
        start, end, special = pieces[i]
        if k == end and special:
            return before + 1
        if special or not special and k < end and _ENDING.match(text[start:end]):
            # what is left of it may join the piece before
            j = max(0, i - 1)
            before -= self._of_piece(text, pieces[j]) if j < i else 0
            head = text[pieces[j][0] : k]
            return before + sum(self._of_piece(head, p) for p in self.pieces(head))
        if _RUN.match(text, k - 1):
            while i and not pieces[i - 1][2] and _RUN.match(text, pieces[i][0]) and _RUN.match(text, pieces[i][0] - 1):
                i -= 1
                before -= self._of_piece(text, pieces[i])
            start = pieces[i][0]
            run = _RUN.match(text, start).group()
            return before + int(self.prefixes(run)[len(run[: k - start].encode())])
        return before + int(self.prefixes(text[start:end])[len(text[start:k].encode())])

    def within(self, text: str | None, limit: int) -> int:
        """Characters of the longest prefix that has ``limit`` tokens at most."""
        if not text:
            return 0
        if not self.rules.sure(text):
            return self._longest(text, self.pieces(text), limit)
        n = at = 0
        for c in self.rules.cut(text):
            source = self.rules._of_chunk(c)
            more = self._counted(c)
            if n + more > limit:
                return at + self._longest(source, [(*m.span(), False) for m in _BYTE_PIECES.finditer(source)], limit - n)
            n, at = n + more, at + len(source)
        return len(text)

    def _longest(self, text: str, pieces: list[Piece], limit: int) -> int:
        """The same for a text cut into pieces: the piece where the limit is passed, and what a cut can change around it."""
        n, upto = 0, [0]
        for i, p in enumerate(pieces):
            n += self._of_piece(text, p)
            upto.append(n)
            if n > limit:
                break
        else:
            return len(text)
        last = i  # pieces behind it matter where a cut there can join this one
        while last + 1 < len(pieces) and (pieces[last + 1][2] or _RUN.match(text, pieces[last][1] - 1) and _RUN.match(text, pieces[last][1])):
            upto.append(upto[-1] + self._of_piece(text, pieces[last + 1]))
            last += 1
            if pieces[last][2]:
                break
        for j in range(last, -1, -1):
            start, end, special = pieces[j]
            if not special and not _ENDING.match(text[start : start + 4]):  # all cuts inside it at once
                run, first, r = text[start:end], 0, j
                if _RUN.match(text, end - 1):  # white space: a cut makes all of the run before it one pre-token
                    while r and not pieces[r - 1][2] and _RUN.match(text, pieces[r - 1][1] - 1):
                        r -= 1
                    run = _RUN.match(text, pieces[r][0]).group()
                    first = start - pieces[r][0]
                elif _RUN.match(text, start):  # but for the one behind its leading space
                    first = 1
                table = np.frombuffer(t, np.uint8) if isinstance(t := self.prefixes(run), bytes) else t
                ends = np.cumsum([1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in run])
                most = end - pieces[r][0]
                got = np.flatnonzero(table[ends[first:most]].astype(np.int64) <= limit - upto[r])
                if len(got):
                    return pieces[r][0] + first + int(got[-1]) + 1
                if r < j or first == 0 or _RUN.match(text, end - 1):
                    continue
                end = start + 1
            for k in range(end, start, -1):
                if self._cut(text, pieces, j, upto[j], k) <= limit:
                    return k
        return 0


_made: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """One counter per Python worker and file."""
    if path not in _made:
        _made[path] = PrefixCounts(path)
    return _made[path]


def counted(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and keep_chars (the longest prefix with ``limit`` tokens) of every row of ``docs``.

    Null and empty texts have no tokens; repeated rows and equal doc_ids give a row
    each; an empty table gives no rows; other columns are dropped, whatever their
    names.  Time and memory grow with a text's length, also where it is one word.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            n_bytes = [0 if not t else len(t) if t.isascii() else len(t.encode()) for t in texts]
            n = [c.count(t) for t in texts]
            keep = [c.within(t, limit) if k > limit else len(t or "") for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(keep, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str, file: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Exact token counts of every document."""
    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path(file), limit)
