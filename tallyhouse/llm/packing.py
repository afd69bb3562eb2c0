"""Sum-of-squares online packing of tokenised documents into windows.

Each partition packs its own documents, one after the other. A level array counts the partly filled
windows by their fill; a document, or what is left of it after whole windows, goes to the level where
the sum of the squared counts is least afterwards. At the end of a partition the windows that are still
open are filled up from the emptiest ones, and the last is cut into powers of two, which need no padding;
half of them are filled up so before, whenever more than MOST_OPEN are open, which bounds the memory.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyhouse.llm.shared import held, in_arrow, slices, strings

WINDOW = 2048
#: Word forms, and pieces of words, whose ids a Python worker remembers; longer ones than REMEMBERED_CHARS never.
REMEMBERED, REMEMBERED_CHARS = 400_000, 40
#: Windows of a partition that may be open; beyond, half of them are filled up from the emptiest ones.
MOST_OPEN = 4096

# Characters for which lower case, normal form and splitting are certain: Latin letters that are one letter
# of this range in lower case too, digits, and ASCII signs. Words with others go to the library.
_RANGE = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x250))]
_LETTERS = "".join(c for c in _RANGE if c.isalpha() and c.lower() in _RANGE)
_SIGNS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+")
_PLAIN_ROW = re.compile(f"[{_LETTERS}0-9{_SIGNS} ]*")
# The endings that the vocabulary's splitter cuts off, then its runs of letters, digits and signs.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_SIGNS}]+| ")
#: Marks the end of a piece among ranks, no byte of a plain piece, and that of a word among ids, no id.
_END, _BREAK = b"\x01", b"\xff" * 4


def merge_table(vocabulary: str) -> tuple[dict[bytes, int], np.ndarray, bool]:
    """Of a byte-pair vocabulary with word ends: ranks of byte strings, where a word's end is a byte of its own that joins the last one first; the id of each rank; and whether these ranks merge as the vocabulary's pairs do.

    Ranks name results of merges, pairs name both halves. They agree if every token, merged by pairs,
    comes out as itself: two neighbours that make a token are then always its own pair.
    """
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = {}
    spare = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(256 + spare)] = b
            spare += 1
    suffix = model["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(byte_of[c] for c in (token[: -len(suffix)] if end else token)) + (_END if end else b"")

    ranks: dict[bytes, int] = {}
    ids: list[int] = []
    chars = [c for c, b in byte_of.items() if b != _END[0]]
    for single in (chars, [c + suffix for c in chars]):
        for token in sorted(single, key=raw):
            ranks[raw(token)] = len(ids)
            ids.append(model["vocab"][token])
    ranks[_END] = len(ids)  # never left alone, as it joins every byte first
    ids.append(-1)
    pairs = {}
    for k, merge in enumerate(model["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pairs[left, right] = k
        ranks[raw(left) + raw(right)] = len(ids)
        ids.append(model["vocab"][left + right])
    # the byte before a word's end must join it before anything else does
    order = {token: rank for rank, token in enumerate(sorted(ranks, key=lambda t: (0 if len(t) == 1 else 1 if len(t) == 2 and t.endswith(_END) else 2, ranks[t])))}
    table = np.zeros(len(order), np.int64)
    for token, rank in order.items():
        table[rank] = ids[ranks[token]]
    same = all(alone(left + right, suffix, pairs) for left, right in pairs)
    return order, table, same and len(order) == len(ids)


def alone(token: str, suffix: str, pairs: dict[tuple[str, str], int]) -> bool:
    """Whether merging a token's characters by pairs gives the token."""
    parts = list(token.removesuffix(suffix))
    if token.endswith(suffix):
        parts[-1] += suffix
    while len(parts) > 1:
        k, at = min((pairs.get(p, len(pairs)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if k == len(pairs):
            return False
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, word by word with a bounded memory.

    The tokenizer's normaliser and splitter never join characters over a space or a line break, so the ids
    of a text are those of its words. Plain words are cut as the vocabulary's splitter cuts them, and their
    pieces merged by a rank table made from the vocabulary, if that is found to merge alike; all others go
    to the tokenizers library as they are.
    """

    def __init__(self, vocabulary: str, end_id: int | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.encode_special_tokens = True
        self.end = np.array([] if end_id is None else [end_id], "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.of_piece: dict[str, bytes] = {" ": _BREAK}
        ranks, self.table, self.ranked = merge_table(vocabulary)
        if self.ranked:
            ends = [rank for token, rank in ranks.items() if token.endswith(_END)]
            self.last = np.zeros(len(self.table), bool)
            self.last[ends] = True
            self.ranks = tiktoken.Encoding("pieces", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def merged(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of plain pieces."""
        found, end = list(pieces), _END.decode()
        if not found:
            return {}
        ids = np.array(self.ranks.encode_ordinary(end.join(found) + end), np.int64)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        made = self.table[ids].astype("<u4").tobytes()
        return {x: made[a:b] for x, a, b in zip(found, [0, *ends[:-1]], ends, strict=True)}

    def new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words."""
        plain = words if self.ranked else []
        if not _PLAIN_ROW.fullmatch(joined := " ".join(plain)):
            plain = [w for w in plain if _PLAIN.fullmatch(w)]
            joined = " ".join(plain)
        out = {}
        if plain:
            pieces = _PIECES.findall(joined.lower())
            wanted = set(pieces)
            if len(self.of_piece) > REMEMBERED:
                self.of_piece = {" ": _BREAK} | {x: self.of_piece[x] for x in wanted if x in self.of_piece}
            missing = {x for x in wanted if x not in self.of_piece}
            self.of_piece |= self.merged(missing)
            out = dict(zip(plain, b"".join(map(self.of_piece.__getitem__, pieces)).split(_BREAK), strict=True))
            for x in missing:
                if len(x) > REMEMBERED_CHARS:
                    del self.of_piece[x]
        other = [w for w in words if w not in out]
        found = self.model.encode_batch_fast(other, add_special_tokens=False) if other else []
        return out | {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(other, found, strict=True)}

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = strings(coded.dictionary)
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known} | {"": b""}
        missing = list({w for w in words if w not in self.known})
        self.known |= self.new(missing)
        found = [self.known[w] for w in words]
        for w in missing:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]
        # the ids of every word's every place, gathered from those of the different words
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy()
        many = size[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        place = np.repeat(((np.cumsum(size) - size)[at] - ends[:-1]).astype(np.int32), many)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        bounds = ends[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return [np.concatenate([ids[a:b], self.end]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@held(2)
def encoder(vocabulary: str, end_id: int | None) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(vocabulary, end_id)


class Packer:
    """Pieces (document, start, length) in windows; documents are given by their ids."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.closed: list[list[tuple[int, int, np.ndarray]]] = []
        self._reset()

    def _reset(self) -> None:
        self.open: list[list[list[tuple[int, int, np.ndarray]]]] = [[] for _ in range(self.window + 1)]
        self.opened = 0
        # what the sum of squares gains when a level loses a window, 1 - 2n, or gets one, 1 + 2n; full windows don't count
        self.less = np.full(self.window + 1, 1 << 60)
        self.less[0] = 0
        self.more = np.ones(self.window + 1, np.int64)
        self.more[self.window] = 0

    def add(self, document: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.closed.append([(document, at, ids[at : at + self.window])])
        if whole < len(ids):
            self._place((document, whole, ids[whole:].copy()))  # so that an open window doesn't hold a long document
        if self.opened > self.most_open:
            self._fill(self.most_open // 2)

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.less[level] = 1 - 2 * n if n else 1 << 60
        self.more[level] = 1 + 2 * n

    def _place(self, piece: tuple[int, int, np.ndarray]) -> None:
        size = len(piece[2])
        gain = self.less[: self.window - size + 1] + self.more[size:]
        # of equal gains the fullest window; level 0 is a fresh one
        level = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if level:
            pieces = self.open[level].pop()
            self._count(level)
            self.opened -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self.closed.append(pieces)
        else:
            self._put(pieces, level + size)

    def _put(self, pieces: list[tuple[int, int, np.ndarray]], level: int) -> None:
        self.open[level].append(pieces)
        self._count(level)
        self.opened += 1

    def _fill(self, until: int) -> list[tuple[int, int, np.ndarray]]:
        """Fill the fullest open windows from the emptiest ones until so many are open; what then is left of one, where until is 0."""
        left = deque(pieces for level in range(self.window, 0, -1) for pieces in self.open[level])
        self._reset()
        spare: list[tuple[int, int, np.ndarray]] = []
        while len(left) > until:
            pieces = left.popleft()
            room = self.window - sum(len(p[2]) for p in pieces)
            while room and (spare or left):
                if not spare:
                    spare = left.pop()
                document, start, ids = spare.pop()
                pieces.append((document, start, ids[:room]))
                if len(ids) > room:
                    spare.append((document, start + room, ids[room:]))
                room -= len(pieces[-1][2])
            if room:
                return pieces
            self.closed.append(pieces)
        if not until:
            return spare
        for pieces in [*left, *([spare] if spare else [])]:
            self._put(pieces, sum(len(p[2]) for p in pieces))
        return []

    def finish(self) -> None:
        """Close the open windows: all full but for powers of two."""
        if rest := self._fill(0):
            self._cut(rest)

    def _cut(self, pieces: list[tuple[int, int, np.ndarray]]) -> None:
        total = sum(len(p[2]) for p in pieces)
        queue = list(pieces)[::-1]
        for bit in reversed(range(total.bit_length())):
            room, own = total & (1 << bit), []
            while room:
                document, start, ids = queue.pop()
                own.append((document, start, ids[:room]))
                if len(ids) > room:
                    queue.append((document, start + room, ids[room:]))
                room -= len(own[-1][2])
            if own:
                self.closed.append(own)

    def take(self) -> list[list[tuple[int, int, np.ndarray]]]:
        out, self.closed = self.closed, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if with_ids.

    Every id of a document (those of the tokenizer, then end_id) lies in exactly one piece; the pieces of a
    sequence lie gapless from offset 0. Sequences hold window ids, or a power of two of them at the end of
    a partition. Documents of ids that fit no open window, in any number, leave MOST_OPEN windows open at most. sequence_id is the partition's number times 2**40 plus the place in it, so it is unique.
    Null and empty texts have end_id alone (without end_id: no pieces). Repeated rows are packed each; an
    empty table gives no rows; other columns are ignored. vocabulary must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, end_id)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        packer = Packer(window)
        about: dict[int, list] = {}  # document: id, tokens, tokens not yet given out
        number = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows = []
            for pieces in packer.take():
                offset = 0
                for document, start, ids in pieces:
                    own = about[document]
                    rows.append((own[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), own[1], first, offset, *([ids.tolist()] if with_ids else [])))
                    offset += len(ids)
                    own[2] -= len(ids)
                    if not own[2]:
                        del about[document]
                first += 1
            if rows:
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
                names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1)), strict=True):
                    if len(ids):
                        about[number] = [doc_id, len(ids), len(ids)]
                        packer.add(number, ids)
                        number += 1
                yield from out()
        packer.finish()
        yield from out()

    return in_arrow(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), run, SCHEMA + (", ids array<long>" if with_ids else ""), encoder)
