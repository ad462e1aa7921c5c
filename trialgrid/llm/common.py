"""Shared pieces: work tables in the cluster's shared folder, word hashing in numpy, global offsets."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset in local mode (tests) a temporary one is used."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="trialgrid-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """A scope whose work tables are deleted at its end. It gives a function like `stored` for what the caller goes on with: such a table is outside the scope.

    After an error nothing is deleted, so that what has failed can be looked at.
    """
    _scopes.append([])

    def kept(df: DataFrame, name: str) -> DataFrame:
        own = _scopes.pop()
        try:
            return stored(df, name)
        finally:
            _scopes.append(own)

    try:
        yield kept
    finally:
        own = _scopes.pop()
    for path in own:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Spark's setting to delete a query's shuffle files when it ends, not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read back: later steps neither recompute it nor lose it with an executor. The shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """`docs` with a row id, in the order of its rows. Written once: numbers of a second scan differ where its splits do."""
    return stored(docs.withColumn(id_col, F.monotonically_increasing_id()), name)


def lean(run):
    """A function for mapInArrow that gives memory back to the system when its task ends: idle Python workers live on and would keep it."""

    def inner(batches):
        yield from run(batches)
        release()

    return inner


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of an input row by its content: rows equal in id and text are one document."""
    return F.sha2(F.concat_ws("\u0000", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(text_col, F.lit(""))), 256)


def global_offsets(light: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Add `offset` and `place`, the sum of `size` and the number of all rows before this one in the total order of the columns `order`.

    Range partitions are cut by `order`, which has to be unique, so that equal leading keys still spread out.
    Only one total per partition is gathered, never the rows.
    """
    n = partitions(light.sparkSession)
    part = stored(light.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), f"{name}-range")
    ahead = Window.partitionBy("part").orderBy(*order)
    local = part.withColumn("offset", F.coalesce(F.sum(size).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(ahead) - 1)
    totals = part.groupBy("part").agg(F.sum(size).alias("total"), F.count("*").alias("rows"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"))
    return local.join(F.broadcast(base), "part").withColumns({"offset": F.col("offset") + F.col("base"), "place": F.col("place") + F.col("base_rows")}).drop("base", "base_rows")


# --- words of whole Arrow batches, hashed without a Python loop over words ---

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, at_most: int = 1 << 20):
    """Cut a string column into runs of rows of about at_most bytes (at least one row each): (first row, bytes, row ends)."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_most, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row + 1 : last + 1] - offsets[row]
        row = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first 0 to 8 bytes of a little-endian lane.
_FRONT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def word_bounds(data: np.ndarray, row_ends: np.ndarray):
    """Words `[^\\x20\\x09-\\x0D]+` of concatenated rows: (start byte, end byte, row of each word, first word of each row and one past the last)."""
    rows = len(row_ends)
    if not len(data):
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(rows + 1, np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = row_ends[:-1][row_ends[:-1] < len(data)]
    begins[at] = solid[at]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    at = at[at > 0] - 1
    ends[at] = solid[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, np.concatenate([[0], row_ends]), "left")
    return start, end, np.repeat(np.arange(rows), np.diff(first)), first


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, seeds: int = 1) -> list[np.ndarray]:
    """Independent 64-bit hashes of words, one for each seed. Every lane of eight bytes is mixed with its place before the sum, so that no words are tied by arithmetic."""
    if not len(start):
        return [np.zeros(0, np.uint64)] * seeds
    padded = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    count = (size + 7) >> 3
    heads = np.cumsum(count) - count
    word = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(word)) - heads[word]
    value = lanes[start[word] + 8 * place] & _FRONT[np.minimum(size[word] - 8 * place, 8)]
    with np.errstate(over="ignore"):
        return [mix64(np.add.reduceat(mix64((value ^ seed) + place.astype(np.uint64) * _BASE), heads) + size.astype(np.uint64)) for seed in _SEEDS[:seeds]]


def word_table(data: np.ndarray, row_ends: np.ndarray, lower: bool):
    """Words with one hash: (hash, start byte, end byte, row of each word, first word of each row and one past the last)."""
    start, end, row, first = word_bounds(data, row_ends)
    return word_hashes(data, start, end, lower)[0], start, end, row, first


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the caller leaves out those that cross a row."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + words[i : i + len(out)]
        return mix64(out)


# --- token ids through the tokenizers library ---

_SOLID_ASCII = np.zeros(256, bool)  # ASCII characters that aren't white space
_SOLID_ASCII[33:127] = True
_SOLID_ASCII[:9] = _SOLID_ASCII[14:28] = _SOLID_ASCII[127] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
#: What ends a pre-token before a letter: solid ASCII but for letters and the apostrophe, which contractions keep.
_BREAK = _SOLID_ASCII & ~_ALPHA
_BREAK[0x27] = False
_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts, equal to `Tokenizer.encode(text, add_special_tokens=False)`, faster over a corpus.

    Both kinds of vocabulary end a pre-token where an ASCII letter and another solid ASCII character meet (but after an apostrophe)
    and where a space follows a character that isn't white. A text's ids are those of the pieces between such places, one
    after another. The library encodes each distinct piece of a slice once, all in one call with a special token
    between them; pieces seen more than once in a slice stay in the worker process, up to `cache_size`. Texts that hold the
    string of a special token are encoded whole.
    """

    def __init__(self, path: str, cache_size: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between, self.between_id = next(iter(special.items()))
        self.special = re.compile("|".join(map(re.escape, special)))
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache_size = cache_size
        self.keys = pa.array([], pa.large_string())
        self.met = np.zeros(1 << 22, bool)  # hashes of pieces that came by
        self.flat, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of each."""
        found, sizes = [self.flat[:0]], [self.size[:0]]
        for at in range(0, len(pieces), 50_000):
            ids = self._plain(self.between.join(pieces[at : at + 50_000]))
            ends = np.append(np.flatnonzero(ids == self.between_id), len(ids))
            found.append(ids[ids != self.between_id])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(found), np.concatenate(sizes)

    def _starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of concatenated rows."""
        before, now = data[:-1], data[1:]
        alpha = _ALPHA[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (alpha[:-1] & _SOLID_ASCII[now] | (now == 32) & _SOLID_ASCII[before]) & ~alpha[1:] | _BREAK[before] & alpha[1:]
        # a space after a character of several bytes, if that isn't white
        for i in np.flatnonzero((now == 32) & (before > 127)).tolist():
            cut[i + 1] = not _WHITE.search(bytes(data[max(0, i - 2) : i + 1]).decode(errors="ignore")[-1:])
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        cut[:1] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array, end_id: int):
        """Yield (first row, ids of these rows with end_id after each, ends of the rows in them), some rows at a time; null counts as empty."""
        for row, data, ends in text_slices(column, 1 << 20):
            begins = self._starts(data, ends) if len(data) else np.zeros(0, np.int64)
            offsets = np.append(begins, len(data)).astype(np.int64)
            pieces = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            whole: dict[int, np.ndarray] = {}  # by place, rows with a special token
            for i in self._special_rows(data, ends):
                low = int(ends[i - 1]) if i else 0
                whole[i] = self._plain(bytes(data[low : ends[i]]).decode())
            found = pc.index_in(pieces, value_set=self.keys)
            codes = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.searchsorted(begins, np.concatenate([[0], ends]))  # piece numbers at which rows begin
            for i in whole:
                codes[first[i] : first[i + 1]] = -2
            lost = np.flatnonzero(codes == -1)
            new = pieces.take(pa.array(lost)).dictionary_encode()
            words = new.dictionary
            names = words.to_pylist()
            ids, sizes = self._pieces(names)
            known = len(self.size)
            codes[lost] = known + new.indices.to_numpy()
            tail = np.array([end_id], self.kind)
            extra = [*whole.values()]
            flat = np.concatenate([self.flat, ids, tail, *extra])
            size = np.concatenate([self.size, sizes, [1], [len(x) for x in extra]]).astype(np.int64)
            end_code = known + len(sizes)
            for k, i in enumerate(whole):
                codes[first[i]] = end_code + 1 + k
            if whole:
                keep = codes != -2
                kept = np.concatenate([[0], np.cumsum(keep)])
                codes, first = codes[keep], kept[first]
            codes = np.insert(codes, first[1:], end_code)
            row_ends = first[1:] + np.arange(1, len(ends) + 1)
            n = size[codes]
            stop = np.cumsum(n)
            index = np.repeat((np.cumsum(size) - size)[codes] - (stop - n), n) + np.arange(int(stop[-1]))
            yield row, flat[index], stop[row_ends - 1]
            room = self.cache_size - known
            if room > 0 and names:
                bits = np.fromiter(map(hash, names), np.int64, len(names)) & (len(self.met) - 1)
                often = np.flatnonzero(self.met[bits] | (np.bincount(codes[(codes >= known) & (codes < end_code)] - known, minlength=len(names)) > 1))[:room]
                self.met[bits] = True
                at = np.cumsum(sizes) - sizes
                n = sizes[often]
                self.flat = np.concatenate([self.flat, ids[np.repeat(at[often] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]])
                self.size = np.concatenate([self.size, n])
                self.keys = pa.concat_arrays([self.keys, words.take(pa.array(often))])

    def _special_rows(self, data: np.ndarray, ends: np.ndarray) -> list[int]:
        rows = np.unique(np.searchsorted(ends, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right"))
        return [int(i) for i in rows if self.special.search(bytes(data[ends[i - 1] if i else 0 : ends[i]]).decode(errors="replace"))]


def encoder(path: str) -> Encoder:
    """One per worker process, with its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
