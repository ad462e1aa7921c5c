r"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts (operator 13).

A line's key is the line between newlines without `[\x20\x09-\x0D]` at both ends and with A-Z lower-cased, held as two independent 64-bit
hashes. A key is common when at least `least` documents hold it. A `LineIndex` has two stored tables:

- `refs` (a, b, docs): for each key the exact number of documents. Documents come in and go out by adding or subtracting their keys.
- `filters` (shard, cells): a cuckoo filter of 16-bit fingerprints, four to a bucket, of each shard's common keys. A key that reaches `least`
  is inserted, one that falls below it is deleted; where a shard would pass three quarters of its cells, all shards are built anew from `refs`.

`clean` asks the filters in one pass over the texts. What they pass is confirmed: the distinct passed keys of these documents meet the
common keys of `refs`, and those that aren't common (chance 8 in 65,536 a key) go along as exceptions. So the result is that of the exact
counts, also for documents that aren't in the index, and a deleted document leaves no trace. Filters and exceptions go to every task only if they are
counted to be at most FILTER_BYTES; a larger index joins (row, line, key) with the common keys by shuffle instead, with equal results.

Null or empty texts are one empty line. Keys of fewer than `chars` code points are never common. A row is a document, so repeated rows
count apart. Columns other than doc_id and text are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.common import _SPACE, lean, mix64, new_path, numbered, stored, text_slices, word_hashes

FILTER_BYTES = 1 << 26
BUCKETS, BITS, SLOTS = 1 << 14, 16, 4  # by shard; a shard is filled to half when it is built
SALTS = 64


def line_keys(data: np.ndarray, row_ends: np.ndarray, chars: int):
    """Lines of concatenated rows: (first byte, end byte without newline, row, two hashes of the key, whether the key has `chars` code points)."""
    row_starts = np.concatenate([[0], row_ends[:-1]]).astype(np.int64)
    newline = np.flatnonzero(data == 10)
    own = np.searchsorted(row_ends, newline, "right")
    start = np.sort(np.concatenate([row_starts, newline + 1]), kind="stable")
    row = np.sort(np.concatenate([np.arange(len(row_ends)), own]), kind="stable")
    end = np.sort(np.concatenate([newline, row_ends]), kind="stable")
    solid = np.flatnonzero(~_SPACE[data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = high > low
    left, right = start.copy(), start.copy()
    left[full], right[full] = solid[low[full]], solid[high[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    able = full & (points[right] - points[left] >= chars)
    a, b = np.zeros((2, len(start)), np.uint64)
    a[full], b[full] = word_hashes(data, left[full], right[full], lower=True, seeds=2)
    return start, end, row, a, b, able


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def key_counts(docs: DataFrame, chars: int = 1) -> DataFrame:
    """(a, b, docs): in how many documents each key stands; keys are counted in each slice of a task first."""

    def run(batches):
        for batch in batches:
            for _, data, ends in text_slices(batch.column("text"), 1 << 23):
                _, _, row, a, b, able = line_keys(data, ends, chars)
                row, a, b = row[able], a[able], b[able]
                order = np.lexsort((row, b, a))
                row, a, b = row[order], a[order], b[order]
                key = np.ones(len(a), bool)
                key[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                once = key.copy()
                once[1:] |= row[1:] != row[:-1]
                held = np.add.reduceat(once.astype(np.int64), np.flatnonzero(key)) if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([_signed(a[key]), _signed(b[key]), pa.array(held)], ["a", "b", "docs"])

    return docs.select("text").mapInArrow(lean(run), "a bigint, b bigint, docs bigint").groupBy("a", "b").agg(F.sum("docs").alias("docs"))


# --- cuckoo filters ---


def _homes(b: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and first bucket of keys, from their second hash; the first gives the shard."""
    return np.maximum(b & np.uint64((1 << bits) - 1), np.uint64(1)).astype(np.uint16), (b >> np.uint64(16)) % np.uint64(buckets)


def _other(bucket: np.ndarray, print_: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ (mix64(print_.astype(np.uint64)) % np.uint64(buckets))  # a power of two


def cuckoo_insert(cells: np.ndarray, b: np.ndarray, bits: int = BITS, rounds: int = 2_000) -> bool:
    """Put the keys' fingerprints into cells (buckets x SLOTS), all pending ones a round; False if some found no place."""
    print_, bucket = _homes(b, len(cells), bits)
    for step in range(rounds):
        if not len(print_):
            return True
        order = np.argsort(bucket, kind="stable")
        print_, bucket = print_[order], bucket[order].astype(np.int64)
        turn = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)  # the how manieth of its bucket
        free = cells[bucket] == 0
        fits = turn < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(turn, SLOTS - 1)]
        cells[bucket[fits], slot[fits]] = print_[fits]
        out = ~fits & (turn == free.sum(1))  # one of each full bucket takes a place; the others wait or move on
        if step > 1:  # all try both of their buckets first
            at = bucket[out], (bucket[out] + step) % SLOTS
            thrown = cells[at].copy()
            cells[at] = print_[out]
            print_, bucket = np.concatenate([print_[~fits & ~out], thrown]), np.concatenate([bucket[~fits & ~out], bucket[out]]).astype(np.uint64)
        else:
            print_, bucket = print_[~fits], bucket[~fits].astype(np.uint64)
        bucket = _other(bucket, print_, len(cells))
    return not len(print_)


def cuckoo_delete(cells: np.ndarray, b: np.ndarray, bits: int = BITS) -> None:
    """Take one copy of each key's fingerprint out; all keys have been inserted."""
    print_, bucket = _homes(b, len(cells), bits)
    for print_, *both in zip(print_, bucket.astype(int), _other(bucket, print_, len(cells)).astype(int), strict=True):
        for at in both:
            slot = np.flatnonzero(cells[at] == print_)
            if len(slot):
                cells[at, slot[0]] = 0
                break


def cuckoo_has(cells: np.ndarray, shard: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which keys pass the filters `cells` (shards x buckets x SLOTS)."""
    print_, bucket = _homes(b, cells.shape[1], bits)
    return ((cells[shard, bucket] == print_[:, None]) | (cells[shard, _other(bucket, print_, cells.shape[1])] == print_[:, None])).any(1)


def _sharded(refs: DataFrame, shards: int) -> DataFrame:
    return refs.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))


def _second(part: pd.DataFrame) -> np.ndarray:
    return np.sort(part.b.to_numpy(np.int64).view(np.uint64))


@dataclass
class LineIndex:
    """`refs` and `filters` as stored tables; `insert` and `delete` give a new index and leave this one as it is."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    least: int = 10
    chars: int = 1
    buckets: int = BUCKETS
    bits: int = BITS

    @staticmethod
    def empty(spark: SparkSession, least: int = 10, chars: int = 1, buckets: int = BUCKETS, bits: int = BITS) -> LineIndex:
        return LineIndex(spark.createDataFrame([], "a bigint, b bigint, docs bigint"), spark.createDataFrame([], "shard int, cells binary"), 1, least, chars, buckets, bits)

    @staticmethod
    def build(docs: DataFrame, least: int = 10, chars: int = 1, buckets: int = BUCKETS, bits: int = BITS) -> LineIndex:
        return LineIndex.empty(docs.sparkSession, least, chars, buckets, bits)._rebuilt(stored(key_counts(docs, chars), "line-refs"))

    def save(self, path: str) -> None:
        """A folder with both tables and one row of settings."""
        self.refs.write.parquet(f"{path}/refs")
        self.filters.write.parquet(f"{path}/filters")
        self.refs.sparkSession.createDataFrame([(self.shards, self.least, self.chars, self.buckets, self.bits)], "shards int, least int, chars int, buckets int, bits int").write.parquet(f"{path}/settings")

    @staticmethod
    def open(spark: SparkSession, path: str) -> LineIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return LineIndex(read("refs"), read("filters"), *read("settings").select("shards", "least", "chars", "buckets", "bits").first())

    def common(self) -> DataFrame:
        return self.refs.filter(F.col("docs") >= self.least).select("a", "b")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(key_counts(docs, self.chars))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Without these documents, which have been inserted; an error if some key would be held by fewer than no documents."""
        return self._moved(key_counts(docs, self.chars).withColumn("docs", -F.col("docs")))

    def _moved(self, change: DataFrame) -> LineIndex:
        both = self.refs.select("*", F.lit(0).cast("bigint").alias("more")).unionByName(change.select("a", "b", F.lit(0).cast("bigint").alias("docs"), F.col("docs").alias("more")))
        sums = both.groupBy("a", "b").agg(F.sum("docs").alias("before"), F.sum("more").alias("more")).withColumn("docs", F.col("before") + F.col("more"))
        sums = stored(sums, "line-refs")
        if not sums.filter("docs < 0").isEmpty():
            raise ValueError("a document was deleted that is not in the index")
        refs = sums.filter("docs > 0").select("a", "b", "docs")
        turned = sums.filter((F.col("before") >= self.least) != (F.col("docs") >= self.least)).select("a", "b", (F.col("docs") >= self.least).alias("up"))
        turned = stored(_sharded(turned, self.shards), "line-turns")
        most = refs.filter(F.col("docs") >= self.least).groupBy(F.pmod("a", F.lit(self.shards))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        buckets, bits = self.buckets, self.bits
        if most > buckets * SLOTS * 3 // 4:
            return self._rebuilt(refs)

        def update(key: tuple, old: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
            cells = np.frombuffer(old.cells[0], "<u2").reshape(buckets, SLOTS).copy() if len(old) else np.zeros((buckets, SLOTS), "<u2")
            up = turns.up.to_numpy(bool)
            cuckoo_delete(cells, _second(turns[~up]), bits)
            fits = cuckoo_insert(cells, _second(turns[up]), bits)
            return pd.DataFrame({"shard": [key[0]], "cells": [cells.tobytes() if fits else b""]})

        filters = stored(self.filters.groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(update, "shard int, cells binary"), "line-filters")  # a shard's cells bound its keys
        if not filters.filter("length(cells) = 0").isEmpty():
            return self._rebuilt(refs)
        return LineIndex(refs, filters, self.shards, self.least, self.chars, buckets, bits)

    def _rebuilt(self, refs: DataFrame, shards: int = 0) -> LineIndex:
        """With filters from the exact counts alone, and as many shards as these need."""
        common = refs.filter(F.col("docs") >= self.least)
        buckets, bits = self.buckets, self.bits
        shards = shards or max(1, -(-common.count() // (2 * buckets)))

        def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            cells = np.zeros((buckets, SLOTS), "<u2")
            fits = len(part) <= buckets * SLOTS * 3 // 4 and cuckoo_insert(cells, _second(part), bits)
            return pd.DataFrame({"shard": [key[0]], "cells": [cells.tobytes() if fits else b""]})

        filters = stored(_sharded(common, shards).groupBy("shard").applyInPandas(fill, "shard int, cells binary"), "line-filters")
        if not filters.filter("length(cells) = 0").isEmpty():
            return self._rebuilt(refs, 2 * shards)
        return LineIndex(refs, filters, shards, self.least, self.chars, buckets, bits)

    def cells(self) -> np.ndarray:
        """All filters: shards x buckets x SLOTS; `clean` gathers them only up to its bound."""
        out = np.zeros((self.shards, self.buckets, SLOTS), "<u2")
        for row in self.filters.toLocalIterator():
            out[row.shard] = np.frombuffer(row.cells, "<u2").reshape(self.buckets, SLOTS)
        return out

    def clean(self, docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (the text that remains, '' where nothing does) of each document."""
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        if self.shards * self.buckets * SLOTS * 2 > filter_bytes:
            return self._clean_by_join(rows)
        cells, shards, chars, bits = self.cells(), self.shards, self.chars, self.bits

        def passed(data, ends):
            start, end, row, a, b, able = line_keys(data, ends, chars)
            at = np.flatnonzero(able)
            at = at[cuckoo_has(cells, a[at].view(np.int64) % shards, b[at], bits)]
            return start, end, row, a, b, at

        def candidates(batches):
            for batch in batches:
                for _, data, ends in text_slices(batch.column("text"), 1 << 23):
                    _, _, _, a, b, at = passed(data, ends)
                    keys = np.unique(np.stack([a[at], b[at]]), axis=1)
                    yield pa.RecordBatch.from_arrays([_signed(keys[0]), _signed(keys[1])], ["a", "b"])

        odd = stored(rows.select("text").mapInArrow(lean(candidates), "a bigint, b bigint").distinct().join(self.common(), ["a", "b"], "left_anti"), "line-exceptions")
        if odd.count() * 16 > filter_bytes:
            return self._clean_by_join(rows)
        table = odd.toArrow().combine_chunks()
        odd_a, odd_b = (table.column(c).to_numpy().view(np.uint64) for c in "ab")
        order = np.lexsort((odd_b, odd_a))
        odd_a, odd_b = odd_a[order], odd_b[order]

        def run(batches):
            for batch in batches:
                for first, data, ends in text_slices(batch.column("text"), 1 << 23):
                    start, end, row, a, b, at = passed(data, ends)
                    if len(odd_a):
                        near = np.minimum(np.searchsorted(odd_a, a[at]), len(odd_a) - 1)
                        at = at[~((odd_a[near] == a[at]) & (odd_b[near] == b[at]))]
                    drop = np.zeros(len(start), bool)
                    drop[at] = True
                    yield _kept(batch.column("doc_id").slice(first, len(ends)), data, start, end, row, drop, len(ends))

        return rows.mapInArrow(lean(run), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")

    def _clean_by_join(self, rows: DataFrame) -> DataFrame:
        """`clean` where filters or exceptions are too large for every task: common keys are dealt to SALTS places each, as one may stand in many documents."""
        rows, chars = numbered(rows, "rid", "line-rows"), self.chars

        def spread(batches):
            for batch in batches:
                for first, data, ends in text_slices(batch.column("text"), 1 << 23):
                    _, _, row, a, b, able = line_keys(data, ends, chars)
                    at = np.arange(len(row)) - np.searchsorted(row, row)
                    rid = batch.column("rid").slice(first, len(ends)).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(rid[row[able]]), pa.array(at[able]), _signed(a[able]), _signed(b[able])], ["rid", "at", "a", "b"])

        lines = rows.select("rid", "text").mapInArrow(lean(spread), "rid bigint, at bigint, a bigint, b bigint").withColumn("salt", F.pmod(F.hash("rid"), F.lit(SALTS)))
        common = self.common().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.join(common, ["a", "b", "salt"], "left_semi").groupBy("rid").agg(F.collect_list("at").alias("at"))  # of one text

        def run(batches):
            for batch in batches:
                for first, data, ends in text_slices(batch.column("text"), 1 << 23):
                    start, end, row, *_ = line_keys(data, ends, chars)
                    heads = np.searchsorted(row, np.arange(len(ends)))
                    drop = np.zeros(len(start), bool)
                    for i, at in enumerate(batch.column("at").slice(first, len(ends))):
                        if at.is_valid:
                            drop[heads[i] + at.values.to_numpy()] = True
                    yield _kept(batch.column("doc_id").slice(first, len(ends)), data, start, end, row, drop, len(ends))

        return rows.join(found, "rid", "left").select("doc_id", "text", "at").mapInArrow(lean(run), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def _kept(ids: pa.Array, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, drop: np.ndarray, rows: int) -> pa.RecordBatch:
    """The lines of each row that are not dropped, joined by newlines; a row without any has ''."""
    n, gone = np.bincount(row, minlength=rows), np.bincount(row[drop], minlength=rows)
    stay = np.flatnonzero(~drop)
    mine = row[stay]
    again = np.zeros(len(stay), np.int64)
    again[1:] = mine[1:] == mine[:-1]  # a newline before it
    size = end[stay] - start[stay] + again
    stop = np.cumsum(size)
    index = np.repeat(start[stay] - again - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
    text = data[index] if len(index) else np.zeros(0, np.uint8)
    text = text.copy()
    text[(stop - size)[again > 0]] = 10
    ends = np.concatenate([[0], stop])[np.searchsorted(mine, np.arange(rows + 1))]
    kept = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(gone), kept], ["doc_id", "n_lines", "n_dropped", "kept"])


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, c.key is not null as gone from k left join c using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id"""
