"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhouse.llm.shared import as_texts, map_slices

#: Texts are cut into parts of about so many characters, and runs of white space longer than RUN are encoded by themselves.
PART, RUN = 50_000, 500


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# the library's white space: Python's without the four separators 1C to 1F
_GAP = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
_LONG = re.compile(rf"[^\S\x1c-\x1f]{{{RUN},}}")


def parts(text: str) -> list[str]:
    """The text in parts of about PART characters, cut only where white space follows something else.

    No match of the split pattern goes over such a place: words, numbers and signs hold white space at
    their start only, and runs of white space hold nothing else.
    """
    out, at = [], 0
    while len(text) - at > PART:
        if not (cut := _GAP.search(text, at + PART)):
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode(enc, text: str) -> np.ndarray:
    """The ids of a text as uint32, as encode_ordinary gives them, for texts of any length."""
    if len(text) <= PART and len(text) < RUN:
        return np.array(enc.encode_ordinary(text), np.uint32)
    ids: list[int] = []
    for part in parts(text):
        at = 0
        # a long run of white space: all but its last character is one match when something follows, else all of it is
        for run in _LONG.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            ids += enc.encode_ordinary(part[at : run.start()])
            ids += enc.encode_ordinary(part[run.start() : end])
            at = end
        ids += enc.encode_ordinary(part[at:])
    return np.array(ids, np.uint32)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """Row by row: the id, ids (array of int), and decoded (binary: the bytes that the ids stand for).

    Null text: empty, thus no ids. Repeated rows repeat; an empty table gives no rows; other columns are
    ignored. rank_file must be readable at this path on every executor.
    """

    def work(batch: pa.RecordBatch) -> dict:
        enc = encoding(rank_file, pattern)
        ids = [encode(enc, x) for x in as_texts(batch.column(1))]
        return {"id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())}

    return map_slices(docs.selectExpr(f"cast(`{id_column}` as bigint) as id", "text"), work, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian uint32) and decoded_sha256 of encode_documents' results, digested where they are made."""

    def work(batch: pa.RecordBatch) -> dict:
        enc = encoding(rank_file, pattern)
        n, of_ids, of_bytes = [], [], []
        for text in as_texts(batch.column(1)):
            ids = encode(enc, text)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

    return map_slices(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
