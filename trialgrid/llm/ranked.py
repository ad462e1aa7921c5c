r"""Ranked lexical search, accumulator-limited and term at a time (operator 11).

Terms are `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` with A-Z lower-cased, compared by two independent 64-bit hashes.

1. One pass over the documents writes a forward index: for each document its length and the number and count of each term that any item has.
2. Spark adds up the documents, their lengths, and by term the documents that hold it and its highest impact: the term's bound.
3. Each task scores its documents for every item, the item's rarest term first. A document gets an accumulator only while the bounds of
   this and the later terms could still lift it to the k-th score known so far, that of a full list of earlier documents or the k-th
   partial score of these. From then on the terms only add to the accumulators that there are, so every surviving score is whole.
4. Each task's k best documents of an item meet in two steps of a ranking.

Items are cut into blocks of about BLOCK_TERMS terms, and only a block's terms and weights go to every task: a larger table of items takes
more passes. Every row of `docs` is a document. Null or empty texts have no terms and rank for nothing; items without terms have no rows. Rows
equal in item_id and text are one item; rows that share only the item_id are ranked each on its own. Equal scores go by ascending doc_id,
null ids last. Other columns are not read, and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import global_offsets, lean, stored, text_slices, word_bounds, word_hashes

BLOCK_TERMS = 400_000
_LETTERS = np.full(256, 97, np.uint8)  # terms as letters, all other bytes as spaces
_LETTERS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, two hashes of each term, first term of each row and one past the last) of some rows at a time."""
    for row, data, ends in text_slices(column, 1 << 22):
        start, end, _, first = word_bounds(_LETTERS[data], ends)
        yield row, *word_hashes(data, start, end, lower=True, seeds=2), first


def item_terms(items: DataFrame) -> DataFrame:
    """Stored rows (num, item_id, a, b): an item's distinct terms as two arrays of hashes; items without terms are left out."""

    def run(batches):
        for batch in batches:
            for row, a, b, first in _hashed(batch.column("text")):
                part = [np.unique(np.stack([a[i:j], b[i:j]]).view(np.int64), axis=1) for i, j in zip(first[:-1], first[1:], strict=True)]
                at = pa.array(np.cumsum([0, *(p.shape[1] for p in part)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([p[k] for p in part]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(row, len(part)), *lists], ["item_id", "a", "b"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").distinct().mapInArrow(run, f"item_id {kind}, a array<bigint>, b array<bigint>").filter("size(a) > 0")
    return stored(found.withColumn("num", F.monotonically_increasing_id()), "items")


def forward_index(docs: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """Stored rows (doc_id, n, terms, tfs) of documents with terms: how often each of the given terms, sorted by hash, stands in the document."""
    width = max(len(a), 1)

    def run(batches):
        for batch in batches:
            for row, x, y, first in _hashed(batch.column("text")):
                n = np.diff(first)
                term = np.minimum(np.searchsorted(a, x), width - 1)
                met = np.flatnonzero((a[term] == x) & (b[term] == y)) if len(a) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, met, "right") - 1
                key, tf = np.unique(doc * width + term[met], return_counts=True)
                at = np.searchsorted(key // width, np.arange(len(n) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.astype(np.int32))) for v in (key % width, tf)]
                whole = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(n)), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
                yield whole.filter(pa.array(n > 0))

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id bigint, n bigint, terms array<int>, tfs array<int>"), "forward-index")


def term_at_a_time(post, terms: np.ndarray, weights: np.ndarray, rest: np.ndarray, size: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the documents among `size` that score at least `least`, of which those that are not among the k best may be missing.

    post(term): documents and impacts; rest[j]: the most that terms j and later can add to a document.
    """
    total, live, creating = np.zeros(size, np.int64), np.zeros(size, bool), True
    for j, term in enumerate(terms):
        if creating and not j & (j - 1):  # at every doubling of the terms done
            known = total[live]
            if len(known) >= k:
                least = max(least, int(np.partition(known, len(known) - k)[len(known) - k]))
        creating = creating and rest[j] >= least
        doc, impact = post(term)
        if creating:
            live[doc] = True
        elif not live.any():
            break
        total[doc] += weights[j] * impact  # each document once a term; without an accumulator a sum is never read
    found = np.flatnonzero(live & (total >= least))
    return found, total[found]


def _best(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    gone = ids.is_null().to_numpy(zero_copy_only=False)
    top = np.lexsort((ids.fill_null(0).to_numpy(), gone, -scores))[:k]
    return ids.take(pa.array(top)), scores[top]


def _scores(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], width: int, docs: int, length: int, k: int) -> DataFrame:
    """(num, doc_id, score): each task's k best documents of each query (num, terms, weights, rest)."""

    def run(batches):
        best = [(pa.array([], pa.int64()), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            terms = batch.column("terms").flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
            doc = pc.list_parent_indices(batch.column("terms")).to_numpy()
            m = 10 + 90 * batch.column("n").to_numpy() * docs // length
            order = np.argsort(terms, kind="stable")
            doc, impact = doc[order], (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))[order]
            at = np.searchsorted(terms[order], np.arange(width + 1))
            post = lambda t: (doc[at[t] : at[t + 1]], impact[at[t] : at[t + 1]])  # noqa: E731, B023
            for q, (_, own, weights, rest) in enumerate(queries):
                ids, scores = best[q]
                least = int(scores[-1]) if len(scores) == k else 1
                found, new = term_at_a_time(post, own, weights, rest, batch.num_rows, k, least)
                if len(found):
                    best[q] = _best(pa.concat_arrays([ids, batch.column("doc_id").take(pa.array(found))]), np.concatenate([scores, new]), k)
        for (num, *_), (ids, scores) in zip(queries, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), num)), ids, pa.array(scores)], ["num", "doc_id", "score"])

    return index.mapInArrow(lean(run), "num bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item with a score above 0."""
    queries = item_terms(items)
    placed = stored(global_offsets(queries.withColumn("size", F.size("a").cast("long")), ["num"], "size", "items").withColumn("block", F.expr(f"offset div {block_terms}")), "item-blocks")
    found = None
    for block in range((placed.agg(F.max("block")).first()[0] or 0) + 1):
        part = placed.filter(F.col("block") == block).select("num", "a", "b").toArrow().combine_chunks()  # at most block_terms and one item's
        got = _block(docs, part, k)
        found = got if found is None else found.unionByName(got)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = found.withColumn("salt", F.spark_partition_id() % 256)  # tasks of 256 groups, then the 256 lists
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("num", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("num").orderBy(*order))).filter(F.col("rank") <= k)
    return top.join(queries.select("num", "item_id"), "num").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block(docs: DataFrame, part: pa.Table, k: int) -> DataFrame:
    """`_scores` of the items (num, a, b) of one block."""
    lists = [part.column(c).combine_chunks() for c in "ab"]
    size = lists[0].value_lengths().to_numpy() if len(part) else np.zeros(0, np.int64)
    pairs, term = np.unique(np.stack([x.flatten().to_numpy().view(np.uint64) for x in lists]), axis=1, return_inverse=True)
    width = pairs.shape[1]
    index = forward_index(docs, *pairs)
    n, length = index.agg(F.count("*"), F.sum("n")).first()
    n, length = n or 0, max(length or 0, 1)
    each = index.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    impact = F.expr(f"(1000000000L * e.tfs) div (1000L * e.tfs + 8L * (10L + (90L * n * {n}L) div {length}L))")
    rows = each.groupBy(F.col("e.terms").alias("term")).agg(F.count("*").alias("df"), F.max(impact).alias("top")).toArrow()  # a row a term of the block
    df, top = np.zeros(width, np.int64), np.zeros(width, np.int64)
    df[rows.column("term").to_numpy()], top[rows.column("term").to_numpy()] = rows.column("df").to_numpy(), rows.column("top").to_numpy()
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    queries = []
    for num, own in zip(part.column("num").to_pylist(), np.split(term.ravel(), np.cumsum(size)[:-1]) if len(size) else [], strict=True):
        own = own[(df[own] > 0) & (weight[own] > 0)]
        own = own[np.lexsort((own, df[own]))]
        queries.append((num, own, weight[own], np.cumsum((weight[own] * top[own])[::-1])[::-1]))
    return _scores(index, queries, width, n, length, k)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""with d as (select doc_id, {_WORDS} as w from documents), q as (select distinct item_id, unnest({_WORDS}) as t from benchmark),
n as (select doc_id, len(w)::bigint as n from d where len(w) > 0), c as (select count(*)::bigint as docs, sum(n)::bigint as length from n),
p as (select doc_id, t, count(*)::bigint as tf from (select doc_id, unnest(w) as t from d) where t in (select t from q) group by all),
f as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by t, docs),
m as (select doc_id, 10 + (90 * n * docs) // length as m from n, c),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join p using (t) join f using (t) join m using (doc_id) group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) where rank <= 10"""
