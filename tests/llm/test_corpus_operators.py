"""Operators over the whole corpus: lines, near duplicates, substrings, packing, shards, vectors."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tallyhouse.llm import linedup, neardup, packing, sharding, substrings, suffixes, vectors
from tallyhouse.llm.components import components
from tallyhouse.llm.shared import word_hashes

SCHEMA = "doc_id long, text string, source string"
EDGE = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "a"), (4, "x y", None), (5, "x y", "c"), (5, "x y", "c"), (None, "only", "a"), (7, "long " * 30_000, "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 1, 2, "q") for r in EDGE], SCHEMA + ", size long, key long, h string")


def corpus(seed, n=120):
    """Documents with copies, near copies, shared lines and passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    shared = [" ".join(word() for _ in range(8)) for _ in range(4)]
    passage = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append((i, r.choice(out)[1]))
        elif out and kind < 0.4:
            words = r.choice(out)[1].split(" ")
            for _ in range(r.randint(1, 6)):
                words[r.randrange(len(words))] = word()
            out.append((i, " ".join(words)))
        else:
            lines = [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))]
            if r.random() < 0.4:
                lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
            if r.random() < 0.3:
                lines.append(passage)
            out.append((i, "\n".join(lines)))
    return [(i, t, f"s{r.randrange(9)}") for i, t in out]


# --- lines
def lines_by_hand(rows, least):
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(" ")
            if line:
                sites[line].add(s)
                first[line] = min(first.get(line, (d, p)), (d, p))
    out = {}
    for d, t, _ in rows:
        keep, gone = [], 0
        for p, line in enumerate(t.split("\n")):
            bare = line.strip(" ")
            if bare and len(sites[bare] - {None}) >= least and first[bare] != (d, p):
                gone += 1
            else:
                keep.append(line)
        out[d] = ("\n".join(keep), gone)
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 3), (2, 5)])
def test_lines_against_plain_python(spark, seed, least):
    rows = corpus(seed)
    found = linedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), least).collect()
    assert {r.doc_id: (r.kept_text, r.n_removed) for r in found} == lines_by_hand(rows, least)


def test_line_edges(edge):
    rows = linedup.drop_boilerplate(edge, 2).collect()
    assert len(rows) == len(EDGE) and "key" in rows[0].asDict() and "h" in rows[0].asDict()
    by = {(r.doc_id, r.text): (r.kept_text, r.n_lines, r.n_removed) for r in rows}
    assert by[1, None] == (None, 0, 0) and by[2, ""] == ("", 0, 0) and by[4, "x y"] == ("x y", 1, 0)
    assert linedup.drop_boilerplate(edge.limit(0)).count() == 0


def test_band_takes_in_the_threshold():
    for least in (2, 5, 100):
        low, high = linedup.band(least)
        assert low < least <= high


# --- near duplicates
def components_by_hand(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(rows[i][0], len(sets[i]), least.get(top(i))) for i in range(len(rows))]


@pytest.mark.parametrize(("seed", "words"), [(3, 4), (4, 5)])
def test_near_duplicates_against_all_pairs(spark, seed, words):
    rows = corpus(seed, 200)
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), neardup.Rule(words, 80)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(components_by_hand(rows, words, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_family_without_its_original(spark):
    """Copies that differ from a missing original in a tenth of their words each: some pairs are linked, most aren't."""
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        at = r.randrange(100)
        own[at : at + r.randint(4, 16)] = [f"c{i}"]
        rows.append((i, " ".join(own), "s"))
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), neardup.Rule(4, 80)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == sorted(components_by_hand(rows, 4, 80))


def test_near_duplicate_edges(edge):
    found = neardup.near_duplicates(edge, neardup.Rule(4, 80)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (7, 1, 7, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(edge.limit(0)).count() == 0


def thue_morse(n):
    """A word and its complement whose sums of letter times base**place are equal modulo 2**64 for every odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 64, 40])
def test_words_that_polynomials_confuse(spark, n):
    a, b = thue_morse(n)
    assert word_hashes(a.encode())[0] != word_hashes(b.encode())[0]
    rows = [(1, f"one two {a} three four five", "s"), (2, f"one two {b} three four five", "s"), (3, f"one two {a} three four five", "s"), (4, b, "s"), (5, a, "s")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), neardup.Rule(4, 80)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == sorted(components_by_hand(rows, 4, 80))


def test_different_words_have_different_hashes():
    r = random.Random(67)
    words = {bytes(r.choice(b"ab\0\xc3") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 63, 64, 65, 100]))) for _ in range(20_000)} | {b"\0" * n for n in range(1, 80)}
    words = sorted(words)
    one_text = word_hashes(b" ".join(words))
    assert len(set(one_text.tolist())) == len(words) == len(one_text)
    assert [int(word_hashes(w + b"\n")[0]) for w in words[:3000]] == one_text[:3000].tolist()


def test_one_of_each_judges_rows_not_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(2, text["a"]), (5, text["a"]), (5, text["b"]), (5, text["b"]), (2, text["a"] + " more"), (None, text["c"]), (9, text["c"]), (7, ""), (8, ""), (8, ""), (6, None), (3, "x y")]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n long, digest string")
    found = neardup.one_of_each(df, neardup.Rule())
    assert found.columns == df.columns
    got = [(r.doc_id, r.text) for r in found.collect()]
    # of the two texts with the group's least id either may stay
    assert sum(x in ((2, text["a"]), (2, text["a"] + " more")) for x in got) == 1
    rest = [x for x in got if x[0] != 2]
    assert sorted(rest, key=str) == sorted([(5, text["b"]), (9, text["c"]), (7, ""), (8, ""), (6, None), (3, "x y")], key=str)
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_registers_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        every = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
        cut = int(len(every) * (1 - share) / 2)
        a, b = every[: len(every) - cut], every[cut:]
        r.shuffle(every)
        a, b = np.sort(every[: len(every) - cut]), np.sort(every[cut:])
        true = len(np.intersect1d(a, b)) / len(every)
        got, used = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - true) < 0.18 and used[0] == neardup.REGISTERS


def test_components(spark):
    edges = [(b"%08d" % i, b"%08d" % (i + 1)) for i in range(60)] + [(b"z1", b"z2"), (b"z2", b"z1"), (b"z3", b"z3"), (None, b"q")]
    found = dict((bytes(a), bytes(b)) for a, b in components(spark.createDataFrame(edges, "a binary, b binary")).collect())
    assert len(set(found[b"%08d" % i] for i in range(61))) == 1 and found[b"z1"] == found[b"z2"] != found[b"%08d" % 0]
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


# --- substrings
def removed_by_hand(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        out.append((len(b), sum(covered), len([1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1])]), bytes(x for x, c in zip(b, covered, strict=True) if not c)))
    return out


@pytest.mark.parametrize(("seed", "at_once"), [(8, 1000), (9, 2)])
def test_substrings_against_plain_python(spark, seed, at_once):
    rows = corpus(seed) + [(900, "ab" * 400, "s"), (901, "abab" * 90 + "é" * 150, "s"), (902, "z" * 199, "s"), (903, "z" * 200, "s")]
    found = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), at_once=at_once).collect()
    want = {d: w for (d, *_), w in zip(rows, removed_by_hand([t for _, t, _ in rows], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found} == want


@pytest.mark.parametrize(("at_once", "parts"), [(2, 1), (2, 20), (40, 1), (1000, 20)])
def test_substrings_around_a_hot_anchor(spark, monkeypatch, at_once, parts):
    """One passage in many places: before it, behind it, and at both sides something else, or something that some others have too."""
    monkeypatch.setattr(substrings, "PART_KINDS", parts)
    r = random.Random(61)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core, ends = word(120), [word(90) for _ in range(6)]
    side = lambda: r.choice([word(150), r.choice(ends), word(r.randint(0, 60)) + r.choice(ends)[r.randint(0, 80) :]])
    rows = [(i, side() + core + side(), "s") for i in range(250)] + [(900, "x", "s"), (901, core, "s"), (901, core, "s")]
    found = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), at_once=at_once).collect()
    want = sorted((d, *w) for (d, *_), w in zip(rows, removed_by_hand([t for _, t, _ in rows], 200), strict=True))
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in found) == want
    assert 0 < sum(w[2] > 0 for w in want) < len(want)


def test_substrings_in_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rng = random.Random(5)
    common = rng.randbytes(150).hex()
    rows = [(i, rng.randbytes(40).hex() + common * (i % 2) + rng.randbytes(40).hex()) for i in range(40)] + [(1, "copy " * 60)] * 2
    found = []
    # before, the limit stayed at 64 MB; one row in a batch gives what one batch of all rows does
    for given, then in (("64m", 4 << 20), ("1k", 1 << 10)):
        spark.conf.set(name, given)
        found.append(sorted(tuple(r) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == then
    spark.conf.unset(name)
    by_hand = removed_by_hand([t for _, t in rows], substrings.SIZE)
    assert found[0] == found[1] == sorted((i, n, gone, spans, hashlib.sha256(rest).hexdigest()) for (i, _), (n, gone, spans, rest) in zip(rows, by_hand, strict=True))


def test_substring_edges(edge):
    rows = substrings.digest(edge).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGE) and by[7].n_removed == by[7].n_bytes == 150_000 and by[7].n_spans == 1
    assert by[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and by[5].n_removed == 0
    assert substrings.digest(edge.limit(0)).count() == 0


def test_pieces_of_long_texts_agree(spark, monkeypatch):
    r = random.Random(2)
    rows = [(1, "".join(r.choice("abcd") for _ in range(3000)), "s"), (2, "", "s")]
    rows[1] = (2, "x" * 37 + rows[0][1][500:2500] + "y" * 50, "s")
    monkeypatch.setattr(substrings, "PIECE", 700)
    whole = rows[0][1].encode()
    cut = substrings.contexts(whole, np.array([len(whole)]))
    assert cut[3][0] == 0 and cut[4][-1] == len(whole) - 200 and (cut[3][1:] == cut[4][:-1] + 1).all()
    found = {r.doc_id: r.n_removed for r in substrings.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: 2000, 2: 2000}


def test_deep_shallow_order():
    r = random.Random(19)
    for _ in range(60):
        alphabet = r.choice([b"ab", b"abc\xff\x00", bytes(range(256))])
        base = bytes(r.choice(alphabet) for _ in range(90))
        strings = [base[: r.randint(0, 90)] + bytes(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 40))]
        order = suffixes.deep_shallow_order(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        left, right = [s[::-1] for s in strings], strings[::-1]
        got = suffixes.widest(left, right, 20)
        for i in range(len(strings)):
            pairs = [(suffixes.common(left[i], left[j]), suffixes.common(right[i], right[j])) for j in range(len(strings)) if j != i]
            pairs = [p for p in pairs if sum(p) >= 20]
            assert got[i] == ((max(a for a, _ in pairs), max(b for _, b in pairs)) if pairs else None)


# --- packing
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_as_the_library_does():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    texts = ["", "  ", "It's the END!! of <|endoftext|> it", "été ÉTÉ été İstanbul ΣΑΣ ǅ", "a b c\td\x1ce", "日本 ٣٤ 12345 x²", "'s 'll it'll", "a" * 500, "̸ ̈x", "##%% $$ | . ,.!", "Straße ﬁ Ⅷ ŉ"]
    own = packing.encoder(VOCABULARY, 1)
    assert own.ranked
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text
    r = random.Random(23)
    mixed = ["".join(r.choice("abcdeéÀ 0.!'\n") for _ in range(r.randint(0, 80))) for _ in range(500)]
    for text, ids in zip(mixed, own.encode(mixed), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_words_of_every_letter_encode_as_the_library_does():
    """Letters whose lower case is elsewhere, signs, endings and blanks, alone, between letters and mixed."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    own, r = packing.encoder(VOCABULARY, 1), random.Random(24)
    texts = []
    for c in map(chr, [*range(0x250), 0x2028, 0x300, 0x308, 0x1E9E, 0xFB01]):
        texts += [c, f"ab{c}cd", f"x {c} y", c * 3, f"it'{c}s", f"{c}'s", f"1{c}.a "]
    every = [*map(chr, range(0x250)), *["'s", "'RE", " ", " ", "\n"] * 20]
    texts += ["".join(r.choice(every) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(r.choice("abeioU''.,!1sSdDtT  \n") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_words_encode_alike_when_the_memory_is_full(monkeypatch):
    own, texts = packing.encoder(VOCABULARY, 1), [t or "" for _, t, _ in corpus(25, 60)]
    want = [x.tolist() for x in own.encode(texts)]
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    assert [own.encode([t])[0].tolist() for t in texts] == want


def test_open_windows_are_bounded():
    """Documents that fit no open window: 3,000 of 1,100 tokens; then sizes of every kind."""
    r = random.Random(33)
    for sizes in ([1100] * 3000, [r.randint(1, 5000) for _ in range(2000)]):
        p = packing.Packer(2048, 64)
        for k, n in enumerate(sizes):
            p.add(k, np.arange(n, dtype=np.uint32))
            assert p.opened == sum(map(len, p.open)) <= 64
        p.finish()
        fills = [sum(len(x[2]) for x in w) for w in p.closed]
        assert all(n == 2048 for n in fills if n & (n - 1)) and sum(n < 2048 for n in fills) <= 11
        whole = defaultdict(list)
        for w in p.closed:
            for k, start, ids in w:
                assert ids[0] == start
                whole[k] += ids.tolist()
        assert all(sorted(whole[k]) == list(range(n)) for k, n in enumerate(sizes))


def check_pieces(rows, want, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        total = 0
        for p in pieces:
            assert p.offset == total
            total += p.length
        assert total == window or total < window and total & (total - 1) == 0
    for d, ids in want.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda r: r.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_packing(spark):
    rows = corpus(29, 80) + [(500, "long words " * 3000, "s"), (501, None, "s"), (502, "", "s")]
    ids = {d: packing.encoder(VOCABULARY, 1).encode([t or ""])[0].tolist() for d, t, _ in rows}
    for window in (64, 2048):
        check_pieces(packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), VOCABULARY, window).collect(), ids, window)


def test_packing_edges(edge):
    found = packing.pack_documents(edge, VOCABULARY, with_ids=True).collect()
    assert sum(r.length for r in found if r.doc_id == 5) == 2 * len(packing.encoder(VOCABULARY, 1).encode(["x y"])[0])
    assert all(len(r.ids) == r.length for r in found)
    assert packing.pack_documents(edge.limit(0), VOCABULARY).count() == 0


def test_levels_minimise_the_sum_of_squares():
    r = random.Random(31)
    p = packing.Packer(32)
    counts = Counter()
    for k in range(400):
        size = r.randint(1, 31)
        costs = {}
        for level in [0, *[v for v in counts if counts[v] and v + size <= 32]]:
            after = Counter(counts)
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            costs[level] = sum(v * v for v in after.values())
        p.add(k, np.zeros(size, np.uint32))
        now = Counter({i: len(x) for i, x in enumerate(p.open) if x})
        assert sum(v * v for v in now.values()) == min(costs.values())
        counts = now


# --- shards
def test_shards(spark):
    rows = corpus(37, 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(sharding.shard_by_bytes(docs, 7, partitions=5).collect(), key=lambda r: r.doc_id)
    sizes = [len(t.encode()) + 16 for _, t, _ in rows]
    total, run = sum(sizes), 0
    slots = Counter()
    for (_, t, _), size, r in zip(rows, sizes, found, strict=True):
        shard = run * 7 // total
        assert (r.size, r.text_crc32, r.shard, r.slot, r.law, r.grown_shard) == (size, zlib.crc32(t.encode()), shard, slots[shard], "bytes", None)
        slots[shard] += 1
        run += size


def test_shard_edges(edge):
    found = sharding.shard_by_bytes(edge, 40).collect()
    assert len(found) == len(EDGE) and {r.size for r in found if r.doc_id in (1, 2)} == {16}
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_by_bytes(edge.limit(0)).count() == 0


# --- vectors
def nearest_by_hand(rows, k, every):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, v in sorted(valid, key=lambda r: r[0]):
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in valid if j != i)[:k]
            out |= {(i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(near, 1)}
    return out


def test_recall_and_order(spark):
    r = np.random.default_rng(41)
    centres = r.normal(size=(6, 17))
    rows = [(i, (centres[i % 6] + r.normal(size=17) * 0.4).astype(np.float32).tolist()) for i in range(3000)]
    found = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), k=10, every=50, at_once=25).collect()
    got, want = {(x.query_id, x.vec_id) for x in found}, {(a, c) for a, _, c, _ in nearest_by_hand(rows, 10, 50)}
    assert len(got & want) / len(want) >= 0.97 and len(found) == 600
    by = defaultdict(list)
    for x in found:
        by[x.query_id].append((x.rank, x.score, x.vec_id))
    for v in by.values():
        v.sort()
        assert [a for a, *_ in v] == list(range(1, 11)) and [x[1:] for x in v] == sorted(x[1:] for x in v)


def test_exact_in_a_hot_cluster(spark):
    """A third of each full chunk of 4,096 vectors is one tight cluster of different vectors, which share codes."""
    r = np.random.default_rng(47)
    x = r.normal(size=(8192, 24))
    hot = r.permutation(8192)[:2731]
    x[hot] = r.normal(size=24) + r.normal(size=(len(hot), 24)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1), k=10, every=400).collect()
    assert {(f.query_id, f["rank"], f.vec_id, round(f.score, 9)) for f in found} == nearest_by_hand(rows, 10, 400)
    assert sum(i % 400 == 0 for i in hot) >= 3


def test_cells_that_lie_too_far_are_not_read():
    r = np.random.default_rng(71)
    middles = r.normal(size=(12, 16)) * 20
    x = np.concatenate([m + r.normal(size=(300, 16)) * 0.3 for m in middles])
    ids, centres = np.arange(len(x)), vectors.cells(x)
    own = vectors.distances(x, centres)
    cell, radius = own.argmin(1), np.full(len(centres), -1.0)
    np.maximum.at(radius, cell, own.min(1))
    queries = x[::50]
    reach = vectors.within_sample(ids[::7], x[::7], ids[::50], queries, 10)
    near = vectors.open_cells(queries, reach, centres, radius)
    d = vectors.distances(queries, x)
    for i in range(len(queries)):
        nearest_ = [j for j in np.argsort(d[i], kind="stable") if j != 50 * i][:10]
        assert reach[i] >= d[i, nearest_[-1]] and near[i, cell[nearest_]].all()
    assert near.mean() < 0.25
    assert not vectors.open_cells(queries, np.full(len(queries), np.inf), centres, np.where(np.arange(len(centres)) == 0, -1, radius))[:, 0].any()


def test_blocks_take_every_query_once(spark):
    counts = {0: 3, 1: 50, 2: 4, 5: 4, 6: 1, 9: 20}
    rows = [(100 * cell + k, cell) for cell, n in counts.items() for k in range(n)]
    df = spark.createDataFrame(rows, "id long, cell int")
    parts = [sorted(r.id for r in df.where(c).collect()) for c in vectors.blocks(counts, 10)]
    assert sorted(x for p in parts for x in p) == [i for i, _ in rows] and max(map(len, parts)) <= 20 and vectors.blocks({}, 10) == []


def test_vector_edges(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), (1, same), (2, same), (3, [1.0, 2.0, 4.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, same), (9, [-5.0, 0.0, 1.0]), (100, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.nearest(df, k=10, every=100).collect()}
    assert found == nearest_by_hand(rows, 10, 100)
    assert vectors.nearest(df.limit(0)).count() == 0 and vectors.nearest(df.where("vec_id = 4")).count() == 0
    hot = [(i, same if i % 3 else [float(i), 1.0, 2.0]) for i in range(900)]
    found = vectors.nearest(spark.createDataFrame(hot, "vec_id long, embedding array<double>"), k=10, every=100).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found} == nearest_by_hand(hot, 10, 100)


def test_anisotropic_loss_beats_plain_codes():
    r = np.random.default_rng(43)
    x = r.normal(size=(2000, 16))
    plain, tuned = vectors.fit(x, threshold=0.0), vectors.fit(x, threshold=0.5)

    def parallel(books, extra):
        codes = vectors.assign(x - books.centre, books, extra)
        made = books.centroids[np.arange(books.centroids.shape[0]), codes].reshape(len(x), -1)[:, :16]
        unit = (x - books.centre) / np.linalg.norm(x - books.centre, axis=1, keepdims=True)
        return ((unit * (x - books.centre - made)).sum(1) ** 2).mean()

    assert parallel(tuned, vectors.parallel_weight(16, 0.5) - 1) < parallel(plain, 0.0)
