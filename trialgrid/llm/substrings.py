"""Exact substring removal by super-k-mers (operator 8).

Windows are SPAN consecutive words of one document. A window's minimiser is the least hash of its GRAM-word grams; consecutive
windows that share it form a super-k-mer and travel as one packed string of their words.

1. One pass lists super-k-mers by place, minimiser and a hash of their content. Equal windows have equal minimisers, so those whose
   minimiser nobody else has (and that don't repeat a window inside) are settled without sending a word.
2. Super-k-mers of equal content form a class. All windows of its members but the earliest start earlier elsewhere, so these are
   marked whole, again without sending a word; a passage that many documents share is one member from here on.
3. The earliest members of classes that share their minimiser with another class are packed and dealt to buckets by minimiser. A
   bucket's windows are sorted by content, document and place; all but the first of equal ones mark their words.
4. A bucket of more than BUCKET members is dealt to several, which list their first windows; the first of each of these over all
   is an aggregation with a partial result in each task, joined back to the places.

"Earlier" goes by doc_id (null first), place, and for repeated ids by place of the row in the table. Null and empty texts have no
words; very long texts are cut into windows slice by slice within their task; other columns are not read; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import gram_hash, lean, mix64, numbered, partitions, stored, text_slices, word_bounds, word_hashes

SPAN, GRAM, BUCKET = 20, 4, 4000
#: Windows of a super-k-mer at most; longer ones are cut.
LONGEST = 64
_LEAST = -(1 << 63)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    rest = n - width
    return np.minimum(out[:-rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


def super_kmers(data: np.ndarray, ends: np.ndarray):
    """(row, first word in its row, windows, minimiser, content hash, repeats a window inside) of all super-k-mers of concatenated rows."""
    begin, end, of, first = word_bounds(data, ends)
    none = np.zeros(0, np.int64)
    if len(begin) < SPAN:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    words, others = word_hashes(data, begin, end, False, 2)
    least = _sliding_min(gram_hash(words, GRAM), SPAN - GRAM + 1)
    whole = of[: len(least)] == of[SPAN - 1 :]
    starts = whole.copy()
    starts[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1])
    place = _places(starts)
    starts |= whole & (place % LONGEST == 0)
    at, place = np.flatnonzero(starts), place % LONGEST
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    run = np.cumsum(starts) - 1
    window = gram_hash(others, SPAN)
    with np.errstate(over="ignore"):
        content = np.add.reduceat(np.where(whole, mix64(window + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)), at)
    inside = np.flatnonzero(whole)
    order = inside[np.lexsort((window[inside], run[inside]))]
    same = (window[order[1:]] == window[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
    twice = np.zeros(len(at), bool)
    twice[run[order[1:]][same]] = True
    row = of[at]
    return row, at - first[row], np.bincount(run[whole], minlength=len(at)), least[at], content, twice


def _places(starts: np.ndarray) -> np.ndarray:
    """Distance of each place from the last start before it (or from the beginning)."""
    here = np.arange(len(starts))
    return here - np.maximum.accumulate(np.where(starts, here, 0))


_LISTED = "rid long, doc_id long, start int, size int, minimiser long, content long, twice boolean"


def _listed(batches):
    for batch in batches:
        rid, doc = batch.column("rid").to_numpy(), batch.column("doc_id").fill_null(_LEAST).to_numpy()
        for at, data, ends in text_slices(batch.column("text")):
            row, start, size, least, content, twice = super_kmers(data, ends)
            columns = [rid[at + row], doc[at + row], start.astype(np.int32), size.astype(np.int32), least.view(np.int64), content.view(np.int64), twice]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _LISTED.split(", ")])


_PACKED = "rid long, doc_id long, start int, minimiser long, part int, parts int, packed binary"


def _packed(batches):
    for batch in batches:
        rows: list[tuple] = []
        for rid, doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text", "runs")), strict=True):
            words = text.encode().split()  # bytes split at just these six characters
            doc = _LEAST if doc is None else doc
            rows += [(rid, doc, r["start"], r["minimiser"], r["part"], r["parts"], b" ".join(words[r["start"] : r["start"] + r["size"] + SPAN - 1])) for r in runs]
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])


def _windows(rows: pa.RecordBatch):
    """(row of the batch, place in the document, two hashes) of every window of packed strings."""
    packed = rows.column("packed")
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin, end, of, first = word_bounds(data, offsets[1:].astype(np.int64) - offsets[0])
    words, others = word_hashes(data, begin, end, False, 2)
    whole = np.flatnonzero(of[: len(words) - SPAN + 1] == of[SPAN - 1 :])
    row = of[whole]
    return row, whole - first[row] + rows.column("start").to_numpy()[row], gram_hash(words, SPAN)[whole], gram_hash(others, SPAN)[whole]


_MARKED = "rid long, doc_id long, start int, stop int, h1 long, h2 long"


def _marked(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole buckets: word ranges [start, stop) of windows that are not the first of their kind; of parts of a bucket also the first ones, with hashes."""
    row, place, h1, h2 = _windows(rows)
    rid, doc = rows.column("rid").to_numpy()[row], rows.column("doc_id").to_numpy()[row]
    minimiser, part = rows.column("minimiser").to_numpy()[row], rows.column("part").to_numpy()[row]
    order = np.lexsort((place, rid, doc, h2, h1, part, minimiser))
    later = np.zeros(len(order), bool)
    equal = lambda x: x[order[1:]] == x[order[:-1]]
    later[1:] = equal(h1) & equal(h2) & equal(part) & equal(minimiser)
    again = np.sort(order[later])
    cut = np.ones(len(again), bool)
    cut[1:] = (row[again[1:]] != row[again[:-1]]) | (place[again[1:]] != place[again[:-1]] + 1)
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(again)) - 1 if len(head) else head
    firsts = order[~later]
    firsts = firsts[rows.column("parts").to_numpy()[row[firsts]] > 1]
    both = lambda x, y: pa.concat_arrays([pa.array(x), pa.array(y)])
    at, none = again[head], pa.nulls(len(head), pa.int64())
    columns = [
        both(rid[at], rid[firsts]), both(doc[at], doc[firsts]), both(place[at].astype(np.int32), place[firsts].astype(np.int32)),
        both((place[again[tail]] + SPAN).astype(np.int32), (place[firsts] + SPAN).astype(np.int32)),
        pa.concat_arrays([none, pa.array(h1[firsts].view(np.int64))]), pa.concat_arrays([none, pa.array(h2[firsts].view(np.int64))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MARKED.split(", ")])


def _bucketed(batches):
    """Partitions come sorted by minimiser and part; a bucket may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        m, part = batch.column("minimiser").to_numpy(), batch.column("part").to_numpy()
        own = (m == m[-1]) & (part == part[-1])
        last = batch.num_rows - int(np.argmin(own[::-1])) if not own.all() else 0
        if last:
            yield _marked(_joined([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        elif held and (held[0].column("minimiser")[0].as_py(), held[0].column("part")[0].as_py()) != (m[0], part[0]):
            yield _marked(_joined(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield _marked(_joined(held))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """Ranges (rid, start, stop) of words to remove, from rows (rid, doc_id, text)."""
    spark = rows.sparkSession
    listed = stored(rows.mapInArrow(lean(_listed), _LISTED), "super-kmers")
    counts = stored(listed.groupBy("minimiser").agg(F.count("*").alias("m"), F.max("twice").alias("any")).filter("m > 1 or any").select("minimiser"), "minimisers")
    shared = stored(listed.join(counts, "minimiser"), "shared")
    kind, place = ["minimiser", "content", "size"], F.struct("doc_id", "rid", "start")
    classes = stored(shared.groupBy(*kind).agg(F.min(place).alias("first"), F.count("*").alias("m"), F.max("twice").alias("twice")), "classes")
    copies = shared.join(classes.filter("m > 1").select(*kind, "first"), kind).filter(place != F.col("first")).select("rid", "start", (F.col("start") + F.col("size") + SPAN - 1).cast("int").alias("stop"))

    # written first, so that the join has shuffles of its own and Spark can split a minimiser that many classes have
    several = stored(classes.groupBy("minimiser").agg(F.count("*").alias("c"), F.max("twice").alias("any")).filter("c > 1 or any").select("minimiser", "c"), "several")
    parts = F.ceil(F.col("c") / BUCKET).cast("int")
    sent = classes.select("minimiser", "content", "size", "first.rid", "first.start").join(several, "minimiser").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("content", "size"), F.col("parts")).cast("int"))
    wanted = sent.groupBy("rid").agg(F.collect_list(F.struct("start", "size", "minimiser", "part", "parts")).alias("runs"))
    packed = stored(rows.join(wanted, "rid").mapInArrow(lean(_packed), _PACKED), "packed")
    marked = stored(packed.repartition(partitions(spark), "minimiser", "part").sortWithinPartitions("minimiser", "part").mapInArrow(lean(_bucketed), _MARKED), "marked")
    firsts = marked.filter("h1 is not null")
    first = stored(firsts.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("m")).filter("m > 1").select("h1", "h2", "first"), "firsts")
    later = firsts.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    ranges = ["rid", "start", "stop"]
    return copies.unionByName(marked.filter("h1 is null").select(*ranges)).unionByName(later.select(*ranges))


def _cleaned(batches):
    for batch in batches:
        out: list[tuple] = []
        for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for r in ranges or ():
                gone[r["start"]] += 1
                gone[r["stop"]] -= 1
            keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            kept = b" ".join(words if len(keep) == len(words) else [words[i] for i in keep])
            out.append((doc, len(words), len(words) - len(keep), kept.decode()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (the kept words joined by one space)."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "rid", "rows").select("rid", "doc_id", "text")
    ranges = stored(repeated_ranges(rows), "ranges").groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return rows.join(ranges, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(lean(_cleaned), "doc_id long, n_words long, n_removed long, text string")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
