"""Near-duplicate documents by HyperMinHash: banded compressed registers, estimates, and checks on full shingle sets.

Equal shingle sets are one class from the start, so copies are never compared. Each class has REGISTERS
registers: of the hashes in a register's share of the hash space the least is kept, as its count of
leading zeros and the mantissa bits after the first one. Classes that agree in all registers of a band
are candidates. They are compared with their band's central member first, by the estimate and then on the
full sets; what then still lies in different components of a band is compared in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.shared import as_bytes, chained, in_arrow, kept, map_slices, mixed, release, row_key, word_hashes

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))

#: 128 registers of 16 bits in 32 bands: a pair at similarity 0.8 shares no band with probability 5e-8.
BUCKET_BITS, MANTISSA = 7, 10
REGISTERS, ROWS_PER_BAND = 1 << BUCKET_BITS, 4
BANDS = REGISTERS // ROWS_PER_BAND
#: Classes of a band, and shingles of theirs, that one task compares with as many others at most.
BLOCK, BLOCK_SHINGLES = 1024, 4 << 20


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; documents are linked from a similarity of percent / 100 on."""

    words: int = 5
    percent: int = 80

    def may_link(self, estimates: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Whether estimates from so many registers lie no more than six standard deviations below the similarity that links."""
        s = self.percent / 100
        return estimates >= s - 6 * np.sqrt(s * (1 - s) / np.maximum(used, 1))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of n words, A-Z in lower case; fewer words count as one window."""
    words = word_hashes(text.translate(_LOWER))
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(chained(words, min(n, len(words))) + np.uint64(min(n, len(words)) < n))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers as uint16 of sorted distinct hashes; 0 is an empty one."""
    out = np.zeros(REGISTERS, np.uint16)
    rest = np.uint64(64 - BUCKET_BITS)
    bucket = hashes >> rest
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    value = hashes[first] & ((np.uint64(1) << rest) - np.uint64(1))
    bits = np.zeros(len(value), np.int64)
    left = value.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= (np.uint64(1) << np.uint64(step))
        bits[big] += step
        left[big] >>= np.uint64(step)
    bits += left.astype(np.int64)  # bit length
    zeros = np.minimum(int(rest) - bits, 62)
    under = np.where(bits > MANTISSA, value >> np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64), value << np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64))
    out[bucket[first].astype(np.int64)] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA)) | (under & np.uint64((1 << MANTISSA) - 1))
    return out


#: For each register, the order in which an empty one borrows from the others.
_BORROW = np.argsort(mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def band_words(regs: np.ndarray) -> np.ndarray:
    """The four registers of each band as a word; empty ones take the value of the first in use in their order."""
    lender = _BORROW[np.arange(REGISTERS), (regs[_BORROW] != 0).argmax(1)]
    return np.where(regs != 0, regs, regs[lender]).astype("<u2").view("<u8")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its word, tied to the band's number."""
    with np.errstate(over="ignore"):
        return mixed(band_words(regs) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows, and the registers in use: the share of equal ones among these, less what chance is expected to give."""
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    big, small = np.maximum(n_a, n_b).astype(float), np.minimum(n_a, n_b).astype(float)
    ratio = 4 * (big / np.maximum(small, 1)) / (1 + big / np.maximum(small, 1)) ** 2
    chance = 0.169919487159739093975 * REGISTERS * 2.0**-MANTISSA * ratio * used / REGISTERS
    return np.where(used > 0, (same - chance) / np.maximum(used, 1), 0.0), used


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """key (row_key), doc_id, n (size of the set), digest (of the set; null without words) and regs of each row."""

    def work(batch: pa.RecordBatch) -> dict:
        n, digest, regs = [], [], []
        for text in as_bytes(batch.column(2)):
            found = shingles(text, rule.words)
            n.append(len(found))
            digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            regs.append(registers(found).astype("<u2").tobytes() if len(found) else None)
        return {"key": batch.column(0), "doc_id": batch.column(1), "n": n, "digest": digest, "regs": regs}

    return map_slices(docs.select(row_key().alias("key"), "doc_id", "text"), work, "key long, doc_id long, n long, digest binary, regs binary")


def shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """digest and the set's hashes, for rows of docs."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [shingles(x, rule.words) for x in as_bytes(batch.column(0))]
        return {"digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], "hashes": pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))}

    return map_slices(docs.select("text"), work, "digest binary, hashes array<long>")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def estimated(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule out a link."""
    side = lambda x: classes.select(F.col("digest").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                n_a, n_b = x.column("n_a").to_numpy(), x.column("n_b").to_numpy()
                near = rule.may_link(*estimate(_regs(x.column("regs_a")), _regs(x.column("regs_b")), n_a, n_b))
                near &= 100 * np.minimum(n_a, n_b) >= rule.percent * np.maximum(n_a, n_b)
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(near))

    return in_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a, b = sets.select(F.col("digest").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("digest").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= rule.percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def block_links(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between different components that share a band, enough of them to join what is linked; members: key, band, digest, root, regs, n, hashes.

    In each band the largest component's classes need no comparing with each other. If the band is too
    large for one task, these and the others are dealt into blocks by hash: each two blocks of others, and
    each block of others with each of the largest component, meet in one task, so no task grows with the
    band. A pair is looked at in the first band that it shares, and its full sets are compared there; a
    task gives fewer links than it has classes.
    """
    roots = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = roots.groupBy("key").agg(F.max(F.struct("c", "s", "root")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = sizes.select("key", F.col("most.root").alias("main"), blocks(F.col("c"), F.col("s")).alias("all_"), blocks(F.col("most.c"), F.col("most.s")).alias("mains"), blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("rest"))
    own = members.join(sizes, "key").withColumn("lead", F.col("root") == F.col("main")).withColumn("mine", F.expr("cast(pmod(xxhash64(digest), if(lead, mains, rest)) as int)"))
    meetings = F.expr(
        "CASE WHEN all_ = 1 THEN array(struct('all' AS kind, 0 AS i, 0 AS j)) WHEN lead THEN transform(sequence(0, rest - 1), x -> struct('main' AS kind, x AS i, mine AS j)) "
        "ELSE concat(transform(sequence(0, rest - 1), x -> struct('rest' AS kind, least(x, mine) AS i, greatest(x, mine) AS j)), transform(sequence(0, mains - 1), x -> struct('main' AS kind, mine AS i, x AS j))) END"
    )
    dealt = own.withColumn("t", F.explode(meetings)).select("key", "t.kind", "t.i", "t.j", "band", "digest", "root", "lead", "regs", "n", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        regs, n = _regs(table.column("regs")), table.column("n").to_numpy()
        band, digest, hashes = table.column("band")[0].as_py(), table.column("digest").to_pylist(), table.column("hashes").combine_chunks()
        lead, across = np.array(table.column("lead").to_pylist()), table.column("kind")[0].as_py() == "main"
        words = np.stack([band_words(r) for r in regs])
        parent: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        roots = table.column("root").to_pylist()
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        group = np.array([number[r] for r in roots])
        sets: dict[int, np.ndarray] = {}
        of = lambda i: sets[i] if i in sets else sets.setdefault(i, hashes[i].values.to_numpy())
        out = []
        for i in range(len(n) - 1):
            rest = slice(i + 1, None)
            apart = group[rest] != group[i]
            if across:  # others meet each other elsewhere
                apart &= lead[rest] != lead[i]
            if not apart.any():
                continue
            near = apart & rule.may_link(*estimate(regs[i][None], regs[rest], n[i : i + 1], n[rest]))
            for j in np.flatnonzero(near) + i + 1:
                if top(roots[i]) == top(roots[j]) or int((words[i] == words[j]).argmax()) != band:
                    continue
                both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if 100 * both >= rule.percent * (n[i] + n[j] - both):
                    parent[top(roots[i])] = top(roots[j])
                    out.append((digest[i], digest[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return dealt.groupBy("key", "kind", "i", "j").applyInArrow(compare, "a binary, b binary")


def links_between_classes(classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """node and root of every class (digest, n, regs, key of a row) that is linked with another."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = np.concatenate([band_keys(r) for r in _regs(x.column(1))]) if x.num_rows else np.zeros(0, np.int64)
            at, band = np.repeat(np.arange(x.num_rows), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), x.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band), x.column(0).take(pa.array(at))], names=["key", "band", "digest"])

    bands = in_arrow(classes.select("digest", "regs"), spread, "key long, band int, digest binary")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = kept(bands.join(sizes, "key"))
    # of a family of copies the original shares most bands with the others, so it is what each band's members are compared with first
    weight = shared.groupBy("digest").agg(F.sum("size").alias("weight"))
    centre = shared.join(weight, "digest").groupBy("key").agg(F.max(F.struct("weight", "digest"))["digest"].alias("a"))
    star = shared.select("key", F.col("digest").alias("b")).join(centre, "key").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    close = kept(estimated(star, classes, rule))
    wanted = shared.select("digest").distinct().join(classes.select("digest", "key"), "digest").select("key")
    sets = kept(shingle_sets(docs.withColumn("key", row_key()).join(wanted, "key", "left_semi"), rule).dropDuplicates(["digest"]))
    linked = kept(verified(close, sets, rule))
    found = components(linked)
    # bands of three or more classes that are not one component yet
    rooted = shared.where("size > 2").join(found.withColumnRenamed("node", "digest"), "digest", "left").select("key", "band", "digest", F.coalesce("root", "digest").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rest = kept(block_links(rooted.join(open_, "key", "left_semi").join(classes.select("digest", "regs", "n"), "digest").join(sets, "digest"), rule))
    if not rest.isEmpty():
        before, found = found, components(linked.unionByName(rest))
        if hasattr(before, "_kept"):  # else no class was linked
            release(before)
    release(shared, close, sets, linked, rest)
    return found


def grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of each row its key (row_key), doc_id, n and digest; and of each digest its component's root, component_id (its least doc_id) and pick (the key of one row of the component that has this id)."""
    drawn = kept(sketches(docs, rule))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))  # nulls last
    classes = kept(drawn.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.max("n").alias("n"), F.max("regs").alias("regs")))
    found = links_between_classes(classes.select("digest", "n", "regs", F.col("first.key").alias("key")), docs, rule)
    rooted = classes.select("digest", "first").join(found.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("pick"))
    return drawn.select("key", "doc_id", "n", "digest"), rooted.join(ids, "root").select("digest", "root", "component_id", "pick")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """For each row: doc_id, n_shingles, component_id and kept.

    Rows whose shingle sets have a Jaccard similarity of rule.percent / 100 or more are linked;
    component_id is the smallest doc_id that links reach, and kept says whether it is the row's own. Texts
    with fewer words than a shingle are one shingle of all their words; texts without words, and null
    texts, are linked with nothing and keep their own id. Repeated rows repeat, and rows with one doc_id
    but different texts each have their own component. A null doc_id is no component's id unless it has
    no other; such a row is kept only alone. An empty table gives no rows; other columns are ignored.
    Shingles are told apart by 64-bit hashes.
    """
    drawn, of = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule)
    out = drawn.select("doc_id", "n", "digest").join(of.select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The rows of docs without near duplicates: of each component a row with its smallest doc_id, whatever rows share that id; the columns pass through, but for one named _key.

    Rows are judged, not ids: of rows with one id but different texts each counts for itself. Rows that
    repeat id and text go but for one. Texts without words, and null texts, stay.
    """
    drawn, of = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule)
    stay = of.where("digest = root").select(F.col("pick").alias("_key")).unionByName(drawn.where("digest is null").select(F.col("key").alias("_key")))
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    return docs.withColumn("_key", key).dropDuplicates(["_key"]).join(stay, "_key", "left_semi").drop("_key")
