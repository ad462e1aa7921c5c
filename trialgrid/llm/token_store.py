"""Token-id output as a content-addressed store (operator 10).

A rolling hash cuts every document's id stream into chunks at places set by the ids alone, so equal passages give equal
chunks. Chunks are stored once under the hash of their bytes; a recipe per document lists its chunks; the manifest is a Merkle tree
over the recipes' roots in ascending doc_id order. Reading back builds that tree anew and compares every node.

Layout of a store (Parquet, written and read by Spark alone, so any file system that Spark reaches will do):
  objects/kind=chunk   key = blake2b-128 of the payload, payload = little-endian ids (2 bytes each, 4 for large vocabularies)
  recipes/             one row per document in ascending doc_id order: place, start, n_ids, chunk keys and sizes, root of the keys
  manifest/            one row per node of the tree: level (1 lies over documents), place, documents, ids, root; FAN children a node

Null texts count as empty (only the end id). Equal rows are documents of their own, next to each other in the order; a
null doc_id comes first. Other columns are not carried. An empty table gives an empty store. A missing or changed chunk, recipe or
node raises an error when the store is read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.common import encoder, global_offsets, lean, mix64, new_path

CHUNK_MIN, CHUNK_MASK, CHUNK_MAX, FAN = 64, 255, 2048, 1024
_GEAR_SPAN = 8
_OBJECT = "kind string, key binary, rid long, doc_id long, n_ids long, payload binary, root binary"


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Places after an id where the gear hash of the last 8 ids has 8 low bits of 0. Those of concatenated streams are right from the eighth id of each."""
    gear = mix64(np.arange(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint64) + np.uint64(1))[ids]
    rolled = gear.copy()
    for j in range(1, min(_GEAR_SPAN, len(ids))):
        rolled[j:] += gear[: len(ids) - j] << np.uint64(j)
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(CHUNK_MASK) == 0) + 1


def chunk_ends(cuts: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from begin to end: at its cut places, within the size limits."""
    ends, last = [], begin
    for cut in [*cuts, end]:
        while cut - last > CHUNK_MAX:
            last += CHUNK_MAX
            ends.append(last)
        if cut - last >= CHUNK_MIN or cut == end and cut > last:
            ends.append(cut)
            last = cut
    return ends


def chunk_key(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    while len(leaves) > 1:
        leaves = [chunk_key(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else chunk_key(b"")


def _objects(path: str, end_id: int):
    def run(batches):
        coder, seen = encoder(path), set()
        for batch in batches:
            rids, docs = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
            for at, ids, ends in coder.encode(batch.column("text"), end_id):
                rows: list[tuple] = []
                width, raw, cuts = ids.dtype.itemsize, ids.tobytes(), cut_places(ids)
                own = np.searchsorted(cuts, ends).tolist()
                cuts, begin, used = cuts.tolist(), 0, 0
                for i, (end, upto) in enumerate(zip(ends.tolist(), own, strict=True), at):
                    keys, recipe, last = [], [], begin
                    for stop in chunk_ends(cuts[used:upto], begin, end):
                        payload = raw[last * width : stop * width]
                        key = chunk_key(payload)
                        keys.append(key)
                        recipe.append(key + (stop - last).to_bytes(4, "little"))
                        if key not in seen:  # combine before the shuffle
                            seen.add(key)
                            rows.append(("chunk", key, None, None, stop - last, payload, None))
                        last = stop
                    rows.append(("recipe", rids[i].to_bytes(8, "big"), rids[i], docs[i], end - begin, b"".join(recipe), merkle_root(keys)))
                    begin, used = end, upto
                yield _batch(rows)
                if len(seen) > 300_000:
                    seen.clear()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _OBJECT.split(", ")])


def merkle_tree(recipes: DataFrame, documents: int) -> DataFrame:
    """Nodes (level, node, documents, n_ids, root) over recipes (place, n_ids, root) up to one top node; FAN rows a group at most."""
    nodes, level, out = recipes.select(F.col("place").alias("node"), F.lit(1).cast("long").alias("documents"), "n_ids", F.hex("root").alias("root")), 0, None
    while not level or documents > FAN**level:
        level += 1
        child = F.struct("node", "root")
        nodes = nodes.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("documents").alias("documents"), F.sum("n_ids").alias("n_ids"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["root"]), ""), 256).alias("root"))
        now = nodes.select(F.lit(level).alias("level"), "node", "documents", "n_ids", "root")
        out = now if out is None else out.unionByName(now)
    return out


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> str:
    """Encode `docs` (doc_id, text), write a store into the shared folder and return its path."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(lean(_objects(tokenizer_path, end_id)), _OBJECT)
    # one pass: chunks meet their copies by key, recipes go along under keys of their own
    unique = found.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("rid", "doc_id", "n_ids", "payload", "root")))
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.schema(_OBJECT).parquet(f"{path}/objects").filter("kind = 'recipe'")
    placed = global_offsets(recipes.select("doc_id", "rid", "n_ids", "payload", "root"), ["doc_id", "rid"], "n_ids", "recipes").withColumnRenamed("offset", "start")
    placed.drop("part").repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid").write.option("compression", "zstd").parquet(f"{path}/recipes")
    kept = spark.read.parquet(f"{path}/recipes")
    merkle_tree(kept, kept.count()).write.parquet(f"{path}/manifest")
    return path


# --- reading back ---

_POLYNOMIAL = 0xEDB88320


def _shift_tables() -> np.ndarray:
    """tables[k][b][v]: the register v << 8b of a CRC-32 after 2^k zero bytes."""

    def squared(columns: list[int]) -> list[int]:
        return [times(columns, c) for c in columns]

    def times(columns: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= columns[i]
        return out

    columns = [_POLYNOMIAL] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        columns = squared(columns)
    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(40):
        for b in range(4):
            for v in range(256):
                tables[k, b, v] = times(columns, v << 8 * b)
        columns = squared(columns)
    return tables


_tables: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values after `zeros` more bytes, so that crc(a + b) = crc_shift(crc(a), len(b)) ^ crc(b)."""
    if not _tables:
        _tables.append(_shift_tables())
    crc, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for k in range(40):
        if not (zeros >> k).any():
            break
        on = (zeros >> k & 1).astype(bool)
        v, t = crc[on], _tables[0][k]
        crc[on] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return crc


def _digests(batches):
    """Read stored chunks: check the payload against its key, and take the CRC of its ids as 4-byte integers."""
    for batch in batches:
        keys, crcs = batch.column("key").to_pylist(), []
        for key, payload, n in zip(keys, batch.column("payload").to_pylist(), batch.column("n_ids").to_pylist(), strict=True):
            if chunk_key(payload) != key:
                raise ValueError(f"chunk {key.hex()} doesn't match its content")
            crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{len(payload) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64()), batch.column("n_ids")], names=["key", "crc", "held"])


def _recipe_entries(batches):
    for batch in batches:
        rows = [[], [], []]
        for rid, recipe, root in zip(*(batch.column(c).to_pylist() for c in ("rid", "payload", "root")), strict=True):
            keys = [recipe[i : i + 16] for i in range(0, len(recipe), 20)]
            if merkle_root(list(keys)) != root:
                raise ValueError(f"recipe {rid} doesn't match its root")
            after = 0
            for key, at in zip(reversed(keys), range(len(recipe) - 20, -1, -20), strict=True):
                rows[0].append(rid), rows[1].append(key), rows[2].append(4 * after)
                after += int.from_bytes(recipe[at + 16 : at + 20], "little")
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["rid", "key", "after"])


def _shifted(batches):
    for batch in batches:
        crc = crc_shift(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(crc.astype(np.int64)), batch.column("held")], names=["rid", "part", "held"])


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """The recipes of a store, once its Merkle tree is found to be as the manifest has it. One row, of nodes that differ, reaches the driver."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    key = ["level", "node"]
    whole = manifest.agg(F.max(F.struct("level", "documents")).alias("top")).first().top
    now = merkle_tree(recipes, whole.documents if whole else 0)
    same = F.col("x.documents").eqNullSafe(F.col("y.documents")) & F.col("x.n_ids").eqNullSafe(F.col("y.n_ids")) & F.col("x.root").eqNullSafe(F.col("y.root"))
    wrong = now.alias("x").join(manifest.alias("y"), key, "full").filter(~same).select(*key).first()
    if wrong:
        raise ValueError(f"{path}: node {wrong.node} of level {wrong.level} doesn't match the manifest")
    return recipes


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files of a store: doc_id, start, n_tokens, ids_crc32.

    Every chunk is read once and checked against its key, every recipe against its root, the roots and counts against the manifest;
    the CRC of a document is put together from those of its chunks, so no payload is shuffled and a chunk of many documents is
    a light row.
    """
    recipes = _verified(spark, path)
    chunks = spark.read.schema(_OBJECT).parquet(f"{path}/objects").filter("kind = 'chunk'")
    digests = chunks.select("key", "n_ids", "payload").mapInArrow(lean(_digests), "key binary, crc long, held long")
    entries = recipes.select("rid", "payload", "root").mapInArrow(lean(_recipe_entries), "rid long, key binary, after long")
    parts = entries.join(digests, "key").select("rid", "crc", "after", "held").mapInArrow(lean(_shifted), "rid long, part long, held long")
    whole = parts.groupBy("rid").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("held").alias("n_tokens"))
    read = F.when(F.col("n_tokens").eqNullSafe(F.col("n_ids")), F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("chunks are missing of the recipe at "), F.col("start"))).cast("long"))
    return recipes.select("rid", "doc_id", "start", "n_ids").join(whole, "rid", "left").select("doc_id", "start", read.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild whole documents: doc_id, start, ids (little-endian), in no order. For full restores; it shuffles the payloads."""
    recipes = _verified(spark, path)
    chunks = spark.read.schema(_OBJECT).parquet(f"{path}/objects").filter("kind = 'chunk'").select("key", "payload")
    entries = recipes.select("rid", "payload", "root").mapInArrow(lean(_recipe_entries), "rid long, key binary, after long")
    ordered = entries.join(chunks, "key").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("at"), "payload"))).alias("parts"))
    hexed = F.aggregate("parts", F.lit(""), lambda a, x: F.concat(a, F.hex(x["payload"])))
    return recipes.select("rid", "doc_id", "start").join(ordered, "rid").select("doc_id", "start", F.unhex(hexed).alias("ids"))
