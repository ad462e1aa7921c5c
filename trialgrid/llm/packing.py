"""Packing token sequences along a space-filling curve (operator 1).

Each document becomes a hashed, normalised vector of its token counts, projected to a few dimensions; its place on a
Hilbert curve through them is its sort key. Documents are laid end to end in that order and cut every `length` ids, so a
sequence holds neighbours on the curve and only the last one of a whole corpus is not full.

Null texts count as empty (only the end id). Equal rows are documents of their own, next to each other on the curve (ties
go by doc_id, then by place in the input). Other columns are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import encoder, global_offsets, lean, mix64, stored

HASHED, DIMENSIONS, BITS = 256, 4, 12
#: Spread of a projected unit vector that the cells of the curve cover on either side.
REACH = 3.0


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows) of `bits` bits a coordinate; bits times coordinates is at most 62."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of the subcubes, from the coarsest down
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of hashed count vectors (rows), by a fixed random projection."""
    project = np.random.RandomState(7).normal(size=(vectors.shape[1], dimensions))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    place = vectors / np.maximum(norm, 1e-12) @ project  # about normal, so that the cells below are about evenly filled
    cells = np.clip((place + REACH) / (2 * REACH) * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_key(cells, bits)


def count_vectors(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed hashed counts (rows x HASHED) of the ids of each row but its last, the end id."""
    span = int(ids.max()) + 1 if len(ids) else 1
    mixed = mix64(np.arange(span, dtype=np.uint64) + np.uint64(11))
    bucket, sign = (mixed % np.uint64(HASHED)).astype(np.int64), 1.0 - 2.0 * (mixed >> np.uint64(63)).astype(float)
    weight = sign[ids]
    weight[ends - 1] = 0.0
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return np.bincount(row * HASHED + bucket[ids], weight, len(ends) * HASHED).reshape(len(ends), HASHED)


def _tokenised(path: str, end_id: int):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for at, ids, ends in coder.encode(batch.column("text"), end_id):
                part = batch.slice(at, len(ends))
                keys = np.concatenate([curve_keys(count_vectors(ids[(ends[i - 1] if i else 0) : ends[min(i + 1024, len(ends)) - 1]], ends[i : i + 1024] - (ends[i - 1] if i else 0))) for i in range(0, len(ends), 1024)])
                width = ids.dtype.itemsize
                offsets = pa.py_buffer(np.append(0, ends * width).astype(np.int32))
                held = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(keys, pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), held], names=["rid", "doc_id", "curve", "n", "ids"])

    return run


def _crc_of(ids: bytes, n: int) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes())


def _pieces(length: int, digest: bool):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, n, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "offset", "ids")), strict=True):
                start, width = 0, len(ids) // n
                while start < n:
                    place = (at + start) % length
                    size = min(n - start, length - place)
                    own = ids[start * width : (start + size) * width]
                    out.append((doc, start, size, n, (at + start) // length, place, _crc_of(own, size) if digest else own))
                    start += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.int64() if digest else pa.binary()], strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, digest: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `length` ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 2 bytes each, 4 where the vocabulary needs them), or with `digest` ids_crc32 in
    their place.

    Texts are encoded once into a table in the shared folder. Only (curve, doc_id, size) is sorted by range; the ids join
    their offsets by row id, so neither a hot topic nor copies of one text load one task.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = stored(rows.mapInArrow(lean(_tokenised(tokenizer_path, end_id)), "rid long, doc_id long, curve long, n long, ids binary"), "encoded")
    placed = global_offsets(encoded.select("curve", "doc_id", "rid", "n"), ["curve", "doc_id", "rid"], "n", "curve").select("rid", "offset")
    # a join on the unique row id, neither side broadcast as both grow with the input
    joined = encoded.select("rid", "doc_id", "n", "ids").join(placed.hint("merge"), "rid")
    return joined.select("doc_id", "n", "offset", "ids").mapInArrow(lean(_pieces(length, digest)), f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {'ids_crc32 long' if digest else 'ids binary'}")
