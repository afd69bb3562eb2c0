"""Removal of bytes that stand in repeated long substrings, exact, over all documents.

Each window of SIZE bytes has an anchor, its least-hashed GRAM bytes; equal windows have equal anchors
at equal places. Consecutive windows with one anchor make a context. Only anchors that occur twice or
more can hold repeats. Where all contexts of an anchor are equal, all their bytes repeat; else one
context of each kind is fetched, and deep-shallow sorting of what follows and what precedes the anchor
gives the bytes that repeat. An anchor with many kinds is dealt by the bytes that its windows share, so
that each part is sorted by itself; where these are the whole windows, the members of a part are equal.

Kinds of contexts are told apart by 64 bits of BLAKE2b beside the 64 bits of their anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import as_bytes, eights, in_arrow, kept, map_slices, mixed, release, row_key, slices
from tallyhouse.llm.suffixes import widest

SIZE, GRAM = 200, 24
#: Bytes that one numpy pass handles; longer texts are read in overlapping pieces.
PIECE = 1 << 17
#: Kinds of contexts of an anchor that are sorted together at most; one with more is dealt into parts of so many neighbouring window starts, and a part with PART_KINDS times as many into single ones.
SORTED_AT_ONCE, STARTS, PART_KINDS = 1000, 22, 20

_BIG = np.uint64(0xFFFFFFFFFFFFFFFF)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the place of the least, the leftmost of equal ones."""
    n = len(values)
    rows = -(-n // width)
    block = np.full(rows * width, _BIG)
    block[:n] = values
    block = block.reshape(rows, width)
    column = np.broadcast_to(np.arange(width), block.shape)
    ahead = np.minimum.accumulate(block, axis=1)
    fresh = np.zeros(block.shape, np.int64)
    np.copyto(fresh[:, 1:], column[:, 1:], where=ahead[:, 1:] < ahead[:, :-1])
    ahead_at = np.maximum.accumulate(fresh, axis=1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]
    behind_at = np.minimum.accumulate(np.where(block == behind, column, width)[:, ::-1], axis=1)[:, ::-1]
    base = np.arange(rows)[:, None] * width
    ahead, behind, ahead_at, behind_at = ahead.ravel(), behind.ravel(), (ahead_at + base).ravel(), (behind_at + base).ravel()
    first = np.arange(n - width + 1)
    last = first + width - 1
    return np.where(behind[first] <= ahead[last], behind_at[first], ahead_at[last])


def grams(text: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on. Equal bytes have equal hashes; others seldom, which costs work alone."""
    at = eights(text)
    n = len(text) - GRAM + 1
    with np.errstate(over="ignore"):
        out = at[:n] * np.uint64(0x9E3779B97F4A7C15) + at[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed(out + at[16 : n + 16] * np.uint64(0x165667B19E3779F9))


def contexts(text: bytes, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, anchor place, first and last window start of each context; text holds texts one behind the other, each up to its end."""
    if len(text) < size:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = grams(text)
    at = least_places(hashes, size - GRAM + 1)
    start = np.arange(len(at))
    own = np.searchsorted(ends, start, side="right")
    whole = start + size <= ends[np.minimum(own, len(ends) - 1)]
    start, at, own = start[whole], at[whole], own[whole]
    if not len(start):
        return contexts(b"", ends, size)
    turn = np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])])
    lo = start[turn]
    hi = start[np.concatenate([turn[1:], [True]])]
    at = at[turn]
    # the anchor's place in a context follows from its bytes
    held = b"".join([hashlib.blake2b(text[a:b], digest_size=8).digest() for a, b in zip(lo.tolist(), (hi + size).tolist(), strict=True)])
    return hashes[at], np.frombuffer(held, "<u8"), at, lo, hi


def anchors(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """key, h (anchor), c (context), pos, lo and hi of all contexts of the rows (key, text)."""

    def work(batch: pa.RecordBatch) -> dict:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, ...]] = []
        pieces: list[tuple[int, int, bytes]] = []  # row, offset, bytes

        def flush() -> None:
            ends = np.cumsum([len(x) for _, _, x in pieces])
            h, c, at, lo, hi = contexts(b"".join(x for _, _, x in pieces), ends, size)
            own = np.searchsorted(ends, lo, side="right")
            shift = np.array([o for _, o, _ in pieces])[own] - (ends - np.array([len(x) for _, _, x in pieces]))[own]
            out.append((keys[np.array([r for r, _, _ in pieces])[own]], h.view(np.int64), c.view(np.int64), at + shift, lo + shift, hi + shift))
            pieces.clear()

        total = 0
        for row, text in enumerate(as_bytes(batch.column(1))):
            for offset in range(0, max(0, len(text) - size) + 1, PIECE):
                part = text[offset : offset + PIECE + size - 1]
                if len(part) >= size:
                    pieces.append((row, offset, part))
                    total += len(part)
                if total >= PIECE:
                    flush()
                    total = 0
        if pieces:
            flush()
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return dict(zip(("key", "h", "c", "pos", "lo", "hi"), [pa.array(x.astype(np.int64 if i < 3 else np.int32)) for i, x in enumerate(columns)], strict=True))

    return map_slices(docs.select("key", "text"), work, "key long, h long, c long, pos int, lo int, hi int")


def _sorted_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """h, c, s and e (covered bytes of the context) from rows h, part, c, n, off, cut, ctx that come by h and part; ctx starts at cut in the context, the anchor at off."""
    group: list[tuple[int, int, int, int, bytes]] = []
    out: list[tuple[int, int, int, int]] = []
    current = None

    def close() -> None:
        found = widest([x[4][: x[2] - x[3]][::-1] for x in group], [x[4][x[2] - x[3] :] for x in group], size)
        for (c, n, off, cut, ctx), best in zip(group, found, strict=True):
            if n > 1:
                out.append((current[0], c, cut, cut + len(ctx)))
            elif best:
                out.append((current[0], c, off - best[0], off + best[1]))

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "c", "s", "e"])

    for batch in batches:
        for h, part, *member in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (h, part) != current:
                if group:
                    close()
                group, current = [], (h, part)
            group.append(tuple(member))
        if len(out) > 10_000:
            yield emitted()
    if group:
        close()
    yield emitted()


def dealt(kinds: DataFrame, starts: int, size: int = SIZE) -> DataFrame:
    """kinds (h, part, c, n, off, cut, ctx) once for each group of so many window starts before the anchor that they have windows with, cut to these windows; part is then a hash of the group and the bytes that all its windows share."""
    # a window that starts d bytes before the anchor: the group g of d holds d from g * starts to (g + 1) * starts - 1
    least, most = F.expr(f"greatest(0, {size} - (octet_length(ctx) - (off - cut)))"), F.expr(f"least(off - cut, {size - GRAM})")
    each = kinds.withColumn("a", F.col("off") - F.col("cut")).withColumn("g", F.explode(F.sequence(F.floor(least / starts).cast("int"), F.floor(most / starts).cast("int"))))
    before, behind = F.expr(f"least(a, (g + 1) * {starts} - 1)"), F.expr(f"least(octet_length(ctx) - a, {size} - g * {starts})")
    each = each.withColumn("from", F.col("a") - before).withColumn("to", F.col("a") + behind)
    # where a context's windows end within the group, it still holds all that the group's windows share
    shared = F.expr(f"substring(ctx, a - g * {starts} + 1, {size} - {starts} + 1)")
    part = F.xxhash64("part", "g", F.sha2(shared, 256))
    return each.select("h", part.alias("part"), "c", "n", "off", (F.col("cut") + F.col("from")).alias("cut"), F.expr("substring(ctx, `from` + 1, `to` - `from`)").alias("ctx"))


def covered(texts: DataFrame, size: int = SIZE, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """key and spans (array of s, e; not merged) of the rows (key, text) of which bytes repeat."""
    found = anchors(texts, size)
    # written first: then the join below reads both sides by exchanges of its own, and an anchor that is everywhere can be split
    twice = kept(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).where("n > 1"))
    members = kept(found.join(twice, "h").select("key", "h", "c", "pos", "lo", "hi", (F.col("x") != F.col("y")).alias("mixed")))
    release(twice)
    alike = members.where("not mixed").select("key", F.col("lo").alias("s"), (F.col("hi") + size).alias("e"))
    own = members.where("mixed")
    # one context of each kind, from the text that holds it
    kinds = own.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "lo", "hi")).alias("at"))
    wanted = kinds.select(F.col("at.key").alias("key"), F.struct("h", "c", "n", "at.pos", "at.lo", "at.hi").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, text, some in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    if key != last:  # rows with one key are equal, and the join brings them together
                        rows += [(w["h"], 0, w["c"], w["n"], w["pos"] - w["lo"], 0, text[w["lo"] : w["hi"] + size]) for w in some]
                    last = key
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()], strict=True)], names=["h", "part", "c", "n", "off", "cut", "ctx"])

    fetched = in_arrow(texts.join(wanted, "key").select("key", "text", "wanted"), fetch, "h long, part long, c long, n long, off int, cut int, ctx binary")
    open_, ranges = kept(fetched), None
    for starts, most in ((STARTS, at_once), (1, PART_KINDS * at_once)):
        large = kept(open_.groupBy("h", "part").count().where(F.col("count") > most).select("h", "part"))
        some = not large.isEmpty()
        small = open_.join(large, ["h", "part"], "left_anti") if some else open_
        done = in_arrow(small.repartition("h", "part").sortWithinPartitions("h", "part"), lambda b: _sorted_groups(b, size), "h long, c long, s int, e int")
        ranges = done if ranges is None else ranges.unionByName(done)
        if not some:
            break
        open_ = kept(dealt(open_.join(large, ["h", "part"], "left_semi"), starts, size))
    else:
        # one start each: the members of a part are equal, which leaves nothing to sort
        repeated = open_.groupBy("h", "part").agg(F.sum("n").alias("times")).where("times > 1")
        ranges = ranges.unionByName(open_.join(repeated, ["h", "part"], "left_semi").select("h", "c", F.col("cut").alias("s"), (F.col("cut") + size).alias("e")))
    spans = own.join(ranges, ["h", "c"]).select("key", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
    return alike.unionByName(spans).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, size: int = SIZE, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """For each row: doc_id, kept (binary: the bytes that remain), spans (the maximal runs removed, as s and e), n_bytes and n_removed.

    A byte goes if it lies in a string of size bytes of its text (UTF-8) that also starts anywhere else, in
    the same text or another row's; strings are judged on the input, and never cross rows. Null text:
    empty. Repeated rows are each other's repeats. Shorter texts stay as they are; an empty table gives no
    rows; other columns are ignored.
    """
    texts = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = covered(texts.select("key", "text"), size, at_once)

    def work(batch: pa.RecordBatch) -> dict:
        keep, spans, n_bytes, n_removed = [], [], [], []
        for text, some in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            runs = merged(some)
            edges = [0, *(x for r in runs for x in r), len(text)]
            keep.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"s": s, "e": e} for s, e in runs])
            n_bytes.append(len(text))
            n_removed.append(sum(e - s for s, e in runs))
        return {"doc_id": batch.column(0), "kept": keep, "spans": spans, "n_bytes": n_bytes, "n_removed": n_removed}

    return map_slices(texts.join(found, "key", "left").select("doc_id", "text", "spans"), work, "doc_id long, kept binary, spans array<struct<s:int,e:int>>, n_bytes long, n_removed long")


def digest(docs: DataFrame, size: int = SIZE, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of remove_repeats' rows."""
    return remove_repeats(docs, size, at_once).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


