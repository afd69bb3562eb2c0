"""Quality rules: word and line rules, and a hashed n-gram logistic regression with calibrated probabilities.

The classifier is fitted on a bounded sample of labelled documents; every document is scored, whole, in
Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyhouse.llm.shared import as_bytes, chained, in_arrow, map_slices, mixed, word_hashes

# Fixed values of the base contract.
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

#: Hash bits of each of the four families: words, word pairs, three and five characters.
BITS, FAMILIES = 14, 4
#: Rows that a gradient is summed over at a time, which bounds what it takes beside the features.
CHUNK = 256

#: Labelled documents of each class that are fitted at most, and the probability from which a document is good.
SAMPLE_PER_CLASS, KEEP_AT = 1000, 0.5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    weights: np.ndarray  # one for each family and hash
    bias: float
    slope: float  # of the calibration, applied to weights and bias together
    offset: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def hashed(text: bytes, words: np.ndarray) -> list[np.ndarray]:
    """Indices of the weights of every token, by family."""
    top = np.uint64(64 - BITS)
    out = [mixed(words) >> top, chained(words, 2) >> top if len(words) > 1 else np.zeros(0, np.uint64)]
    # three code points of 21 bits fit a number
    char = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    three = char[:-2] | char[1:-1] << np.uint64(21) | char[2:] << np.uint64(42)
    with np.errstate(over="ignore"):
        five = mixed(three[:-2]) + (char[3:-1] | char[4:] << np.uint64(21)) * np.uint64(0x9FB21C651E98DF25)
    out += [mixed(three + np.uint64(3)) >> top, mixed(five) >> top]
    return [x.astype(np.int64) + (i << BITS) for i, x in enumerate(out)]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text: in each family, the share of its tokens with that hash."""
    found = hashed(text, word_hashes(text))
    at, n = np.unique(np.concatenate(found), return_counts=True)
    sizes = np.array([max(1, len(x)) for x in found])
    return at, n / sizes[at >> BITS]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model | None:
    """Logistic regression by full-batch Adagrad on four fifths of the rows, with classes weighted alike; Platt's calibration on the rest, weighted so too. None if a class is missing."""
    y = np.array([r[2] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return None
    held = np.zeros(len(rows), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    sizes = np.array([len(r[0]) for r in rows])
    width = FAMILIES << BITS
    square = np.zeros(width)
    for at, value, _ in rows:
        square[at] += np.square(value, dtype=np.float64)
    # rare hashes get values as large as frequent ones: each is divided by the root of its mean square
    scale = (np.sqrt(square / len(rows)) + 1e-3 / np.sqrt(len(rows))) * np.sqrt(sizes.mean())
    share = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    parts = []
    for lo in range(0, len(rows), CHUNK):
        own = rows[lo : lo + CHUNK]
        at = np.concatenate([r[0] for r in own]).astype(np.intp)  # as bincount takes them, step by step
        parts.append((lo, at, (np.concatenate([r[1] for r in own]) / scale[at]).astype(np.float32), np.repeat(np.arange(len(own)), sizes[lo : lo + CHUNK]), len(own)))
    w, b, gw, gb = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    z = np.zeros(len(rows))

    def score() -> None:
        for lo, at, value, row, n in parts:
            z[lo : lo + n] = np.bincount(row, value * w[at], n) + b

    for _ in range(steps):
        score()
        pull = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        dw, db = decay * w / width, pull.sum()
        for lo, at, value, row, n in parts:
            dw += np.bincount(at, value * pull[lo : lo + n][row], width)
        gw += dw**2
        gb += db**2
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    score()
    slope, offset = platt(z[held], y[held]) if held.any() and 0 < y[held].mean() < 1 else (1.0, 0.0)
    return Model(w / scale, float(b), slope, offset)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a probability for held-out scores, by Newton's method on smoothed targets; the classes weigh alike, whatever their shares of the rows."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y == 1, len(y) / 2 / good, len(y) / 2 / bad)
    spread = max(1e-9, np.abs(z).max())
    x = np.stack([z / spread, np.ones_like(z)], 1)
    p = np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (q - t)))
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0] / spread), float(p[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """A model of column quality (1 good, 0 bad) of labels (doc_id, quality), from the per_class documents of each class whose ids hash lowest.

    The bound is on labelled rows; their texts are turned into hashed features where they lie, and one task
    fits the model to these, so only its weights reach the driver. Of documents that share an id the least
    text counts. Rows with a null label are left out. None if either class has no document.
    """
    picked = None
    for c in (0, 1):
        own = labels.where(F.col("quality") == c).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)

    def work(batch: pa.RecordBatch) -> dict:
        found = [features(x) for x in as_bytes(batch.column(1))]
        return {"id": batch.column(0), "at": pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), "value": pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())), "y": batch.column(2)}

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), to_arrow_schema(kinds)).sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
        rows = [(a.values.to_numpy(), v.values.to_numpy(), y) for a, v, y in zip(table.column("at"), table.column("value"), table.column("y").to_pylist(), strict=True)]
        if model := fit(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([model.weights.tobytes()], [model.bias], [model.slope], [model.offset])], names=["weights", "bias", "slope", "offset"])

    # at most 2 * per_class rows of two numbers, joined to as many texts
    texts = docs.selectExpr("cast(doc_id as bigint) as id", "text").join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = map_slices(texts.select("id", "text", "y"), work, "id long, at array<int>, value array<float>, y int")
    kinds = rows.schema
    made = in_arrow(rows.repartition(1), fitted, "weights binary, bias double, slope double, offset double").collect()
    return Model(np.frombuffer(made[0].weights), made[0].bias, made[0].slope, made[0].offset) if made else None


def measure(text: bytes, model: Model | None) -> tuple[int, int, int, int, int, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the model's score of a text."""
    data = np.frombuffer(text, np.uint8)
    words = word_hashes(text)
    within = (data != 32) & ((data < 9) | (data > 13))
    chars = int((within & ((data & 0xC0) != 0x80)).sum())
    seen: set[bytes] = set()
    dups = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dups += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
    repeated = 0
    if len(words) > 3:
        triples = chained(words, 3)
        order = np.argsort(triples, kind="stable")
        ranked = triples[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(triples), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(triples)] |= twice
            repeated = int(covered.sum())
    score = 0.0
    if model is not None:
        score = model.bias + sum(float(model.weights[x].mean()) for x in hashed(text, words) if len(x))
    return len(words), chars, int(_IS_SYMBOL[data].sum()), dups, repeated, score


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, keep_at: float = KEEP_AT) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and probability.

    kept: the base rules hold and the calibrated probability of quality reaches keep_at; if the labels lack
    a class, the rules alone decide and probability is null. Null text: no words, so base_failed. Texts are
    read whole. Repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """
    return _applied(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), train(docs, labels, per_class), keep_at, COLUMNS, False)


def judged(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, keep_at: float = KEEP_AT) -> DataFrame:
    """docs with a column kept, as score_quality decides it row by row; the other columns pass through, but for one named kept."""
    return _applied(docs.drop("kept"), train(docs, labels, per_class), keep_at, "kept boolean", True)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def _applied(rows: DataFrame, model: Model | None, keep_at: float, columns: str, through: bool) -> DataFrame:
    # FAMILIES * 2**BITS numbers, whatever the input
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        own = sent.value
        found = [measure(x, own) for x in as_bytes(batch.column("text"))]
        n, chars, symbols, dups, repeated, score = (list(x) for x in zip(*found, strict=True))
        failed = [a < MIN_WORDS or 100 * r > REPEAT_PERCENT * a for a, r in zip(n, repeated, strict=True)]
        p = [None] * len(n) if own is None else own.probability(np.array(score)).tolist()
        keep = [not f and (x is None or x >= keep_at) for f, x in zip(failed, p, strict=True)]
        if through:
            return dict(zip(batch.schema.names, batch.columns, strict=True)) | {"kept": keep}
        return {"doc_id": batch.column("doc_id"), "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeated, "base_failed": failed, "kept": keep, "probability": p}

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {columns}" if through else columns
    return map_slices(rows, work, schema)
