"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 4).

Counts of n-grams (1 to 3 lower-cased characters) come from all labelled rows outside the held-out fold, in one pass with a
partial sum per task. The matrix of log-probabilities (buckets x languages, at most MAX_LANGUAGES) is broadcast; documents are
scored in numpy, some MB of text at a time as a sparse matrix: distinct (document, bucket) pairs with their counts, one gather of
the matrix' rows and one segmented sum.

Null, empty and letterless texts get `und` and score 0. A null doc_id counts as the empty text in the fold rule, repeated rows
get equal answers, ties go to the first language in alphabetical order. Other columns are not read. Without training rows all
is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import lean, mix64

BITS, ORDERS, FOLDS, MAX_LANGUAGES = 15, 3, 5, 512
_LETTER = re.compile(r"[^\W\d_]")
_SLICE = 1 << 18


def has_letter(text: str) -> bool:
    """Whether any character is a letter (signs such as ½ and ② are none)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def grams(text: str):
    """Buckets of the n-grams of a whole text, a slice at a time."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points[(points < 65) | ((points > 90) & (points < 97))] = 32  # digits and signs are the same to every language
    for at in range(0, len(points), _SLICE):
        part = points[max(0, at - ORDERS + 1) : at + _SLICE]
        skip = min(at, ORDERS - 1)
        out, code = [], np.zeros(len(part), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, ORDERS + 1):
                code = (code[:-1] if n > 1 else code) * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(1)
                out.append(mix64(code[max(0, skip - n + 1) :] + np.uint64(n)) >> np.uint64(64 - BITS))
        yield np.concatenate(out).astype(np.int64)


def _count(batches):
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for part in grams(text):
                counts += np.bincount(part, minlength=1 << BITS)
        if len(held) > 64:
            yield from flush()
    yield from flush()


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (buckets x languages) from rows (text, lang)."""
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    summed = rows.mapInArrow(lean(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most 2^15 numbers a language reach the driver
    packed = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(MAX_LANGUAGES + 1).collect()
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix would not be small")
    packed.sort(key=lambda r: r.lang)
    counts = np.zeros((1 << BITS, len(packed)))
    for k, row in enumerate(packed):
        pairs = np.array([tuple(x) for x in row.counts], np.int64).reshape(-1, 2)
        counts[pairs[:, 0], k] = pairs[:, 1]
    smooth = counts + 0.5
    return [r.lang for r in packed], np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32)


def scores(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Summed log-probabilities (texts x languages) of a block of texts."""
    keys, total = [], np.zeros((len(texts), logs.shape[1]))
    for i, text in enumerate(texts):
        keys += [part + (i << BITS) for part in grams(text)]
    if keys:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        row = key >> BITS
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        total[row[heads]] = np.add.reduceat(logs[key & (1 << BITS) - 1] * count[:, None].astype(np.float64), heads)
    return total


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs` but for clashing ones, with lang_pred and score (or other `names`)."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix))
    keep = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", {names[0]} string, {names[1]} double"

    def run(batches):
        known, logs = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, odds = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None and known and has_letter(t)]
            while at:
                block, size = [], 0
                while len(block) < len(at) and (not block or size + len(texts[at[len(block)]]) <= _SLICE):
                    size += len(texts[at[len(block)]])
                    block.append(at[len(block)])
                at = at[len(block) :]
                total = scores([texts[i] for i in block], logs)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i, k, p in zip(block, best.tolist(), share.tolist(), strict=True):
                    found[i], odds[i] = known[k], p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(odds, pa.float64())], names=[*batch.schema.names, *names])

    return keep.mapInArrow(lean(run), schema)


def identify(docs: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the rows outside the held-out fold, predict all rows."""
    return predict(docs, *train(docs.filter(~held_out(F.col("doc_id")))), names)
