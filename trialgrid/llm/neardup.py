"""Near-duplicate detection by an inverted join over MinHash signature coordinates (operator 7).

A document's set holds its distinct shingles of five lower-cased words (a shorter document's whole word sequence is its one
shingle). Documents with Jaccard similarity of at least `threshold` (in hundredths) are linked; linked ones share a component.

1. Equal sets form a class, so exact copies cost one row each and no pair. One member of a class stands for it.
2. A signature has 48 coordinates, each the minima of two hash functions. Every class is posted under each pair of
   (coordinate, value). Two classes at the threshold agree in fewer than `match_of(threshold)` coordinates with a chance below
   one in a million (at 85: in 34.7 on average, and in fewer than 19). So a class with fewer shared postings is skipped, and only
   the first 48 - 19 + 1 = 30 coordinates (the prefix) have to be joined: a pair that agrees in 19 meets in one of them. Of every
   pair that meets in the steps below the collisions are counted over all coordinates, and it is dropped if they are too few;
   only pairs that are left load full sets.
3. Classes that remain get their full sets. `own` counts the shingles that no other remaining class has. As
   intersection <= size - own on either side and union >= intersection + own + other's own, a member of a posting list whose
   own shingles are too many even for the list's best partner is skipped without forming a pair.
4. Linked classes need to be connected, not listed pair by pair. In each list all members are compared with the one that
   has the fewest own shingles; the verified links give components. Then, in each list, each component's best member is
   compared with the list's best. These steps cost a row per posting.
5. The rest is exact. The lists of one centre form a group; its core holds the items of more than half of the members, and a
   member's difference d is what it has beside the core or lacks of it. Two sets x, y differ in |dx| + |dy| - 2 |dx & dy| items, so
   with excess = 185 |d| - 15 n (at 85) they are linked just when 370 |dx & dy| >= excess x + excess y. Members whose excess and
   the group's least one add up to 0 or less are linked with that one for certain; any other pair has to share
   ceil((excess + least excess) / 370) items of d, so it meets in a prefix of the rarest ones. At each such item all are compared with
   one first; then pairs that are in different components still, by their differences. Copies with changes of their own share
   few of these, so a large group of them forms few pairs. Every link is confirmed on full sets.

Null and empty texts and those without words have an empty set, are linked with nothing and keep their own row. Rows that
repeat a doc_id are one document if they have one set; component_id is the smallest doc_id of the component. A null doc_id is
its own component unless other members have an id. Other columns are not carried.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import free_name, gram_hash, lean, mix64, numbered, scratch, stored, text_slices, word_table

WORDS, COORDINATES, ROWS, MISS = 5, 48, 2, 1e-6
#: Differences of more items don't travel with each posting; their pairs are confirmed on full sets alone.
CARRIED = 512
SALTS = 64
#: Up to as many row numbers or doc_ids (8 bytes each, counted before) go to every task; more are joined by shuffle, with equal results.
SENT = 1 << 21
#: Edges of a graph that go to one task, and so to one file, at most on average.
EDGES = 1 << 16
_random = np.random.RandomState(20)
_A = _random.randint(1, 1 << 62, COORDINATES * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.randint(1, 1 << 62, COORDINATES * ROWS).astype(np.uint64)


def match_of(threshold: int) -> int:
    """The most coordinates that a pair at `threshold` agrees in but for a chance below MISS; below 51 not even one is that sure."""
    p = (threshold / 100) ** ROWS
    below, match = (1 - p) ** COORDINATES, 0
    while match < COORDINATES and below < MISS:
        match += 1
        below += comb(COORDINATES, match) * p**match * (1 - p) ** (COORDINATES - match)
    if not match or threshold > 100:
        raise ValueError(f"threshold {threshold}: signatures of {COORDINATES} coordinates find thresholds from 51 to 100")
    return match


def shingle_sets(data: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and where each row begins (one more than rows)."""
    words, _, _, of, first = word_table(data, row_ends, lower=True)
    count = np.diff(first)
    grams = gram_hash(words, WORDS)
    inside = of[: len(grams)] == of[WORDS - 1 :] if len(grams) else np.zeros(0, bool)
    values, rows = [grams[inside]], [of[: len(grams)][inside]]
    for n in range(1, WORDS):  # short rows: the whole sequence
        short = np.flatnonzero(count == n)
        if len(short):
            whole = words[first[short][:, None] + np.arange(n)]
            with np.errstate(over="ignore"):
                out = np.full(len(short), n, np.uint64)
                for i in range(n):
                    out = out * np.uint64(0x2545F4914F6CDD1D) + whole[:, i]
            values.append(mix64(out))
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(row_ends) + 1))


def signatures(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One 64-bit key of each coordinate and its value, for rows that have shingles."""
    full = np.flatnonzero(np.diff(begin))
    heads = begin[:-1][full]
    keys = np.zeros((len(full), COORDINATES), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            key = np.full(len(full), c + 1, np.uint64)
            for r in range(c * ROWS, (c + 1) * ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value * _A[r] + _B[r], heads))
            keys[:, c] = key
    return keys


def _signed(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for row, data, ends in text_slices(batch.column("text"), 1 << 19):
                value, begin = shingle_sets(data, ends)
                sizes = np.diff(begin)
                full = np.flatnonzero(sizes)
                keys = signatures(value, begin)
                sums = np.zeros((2, len(ends)), np.uint64)
                if len(full):
                    for i, salt in enumerate((np.uint64(5), np.uint64(9))):
                        sums[i, full] = np.add.reduceat(mix64(value + salt), begin[:-1][full])
                at = np.zeros(len(ends) + 1, np.int32)
                at[1:] = np.cumsum(sizes > 0) * COORDINATES
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).ravel()))
                part = batch.slice(row, len(ends))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], names=["rid", "doc_id", "n", "h1", "h2", "keys"])


def _sets(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for row, data, ends in text_slices(batch.column("text"), 1 << 19):
                value, begin = shingle_sets(data, ends)
                full = np.flatnonzero(np.diff(begin))
                sums = np.zeros((2, len(ends)), np.uint64)
                if len(full):
                    for i, salt in enumerate((np.uint64(5), np.uint64(9))):
                        sums[i, full] = np.add.reduceat(mix64(value + salt), begin[:-1][full])
                part = batch.slice(row, len(ends))
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(value.view(np.int64)))
                own = (pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *own, lists], names=["doc_id", "h1", "h2", "items"])


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Components of an undirected graph (a, b): (node, root) with the smallest node of each as root, for nodes with edges.

    Alternates the large-star and small-star steps; each writes its edges to the shared folder, so lineage stays short and
    a lost executor costs no step again. Hubs are combined before the shuffle; no neighbour list is ever gathered. The edges,
    counted before, tell how many tasks write: each file of a step, however small, would take three of every shuffle of the next.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(least, "u")
        if larger:  # neighbours above u move to the least node around u
            return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        below = met.filter("v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return below.unionByName(least.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))

    tidy = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tasks = lambda n: max(1, -(-n // EDGES))
    now, before = stored(tidy(edges).coalesce(tasks(edges.count())), name), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = mark
        large = stored(star(now, True).coalesce(tasks(mark[0])), name)
        now = stored(tidy(star(large, False)).coalesce(tasks(mark[0])), name)


def _linked(threshold: int) -> Column:
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return 100 * shared >= threshold * (F.size("items_a") + F.size("items_b") - shared)


def _counted(pairs: DataFrame, keys: DataFrame, match: int) -> DataFrame:
    """Pairs (a, b) of classes that collide in at least `match` coordinates."""
    left, right = keys.select(F.col("cid").alias("a"), F.col("keys").alias("x")), keys.select(F.col("cid").alias("b"), F.col("keys").alias("y"))
    equal = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, one: n + one)
    return pairs.join(left, "a").join(right, "b").filter(equal >= match).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, keys: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes that collide often enough and whose full sets reach the threshold."""
    pairs = _counted(pairs, keys, match_of(threshold))
    left, right = sets.select(F.col("cid").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("cid").alias("b"), F.col("items").alias("items_b"))
    # spread a hub's sets by hash of the other end instead of leaving them where the hub is
    return pairs.join(left, "a").join(right, "b").filter(_linked(threshold)).select("a", "b")


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """Per row of `docs` (numbered by `__rid`): rid, doc_id, n, root (null for empty sets), component_id."""
    match_of(threshold)  # refuses before any work
    rows = docs.select(F.col("__rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(lean(_signed), "rid long, doc_id long, n long, h1 long, h2 long, keys array<long>"), "signed")
    light = signed.select("rid", "doc_id", "n", "h1", "h2")
    classes = stored(light.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least")), "classes")
    with scratch(docs.sparkSession) as kept:
        roots = kept(_class_components(docs, signed, classes, threshold), "roots")
    named = classes.join(roots, classes.cid == roots.node, "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("h1", "h2", F.col("n").alias("size"), "root", "component_id")
    out = light.join(of, (light.h1 == of.h1) & (light.h2 == of.h2) & (light.n == of.size), "left")
    return out.select("rid", "doc_id", "n", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return _grouped(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__rid")), threshold).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """Rows of `docs`, one of each group: the one with the smallest doc_id (null last), of those the first. Empty texts all stay."""
    own = free_name(docs, "__rid")
    rows = numbered(docs, own, "rows")
    with scratch(docs.sparkSession) as kept:
        found = kept(_grouped(rows.select("doc_id", "text", F.col(own).alias("__rid")), threshold).select("rid", "doc_id", "root"), "grouped")
    best = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"))
    goes = stored(found.filter("root is not null").join(best.select("best.rid"), "rid", "left_anti").select(F.col("rid").alias(own)), "goes")
    few = goes.count() <= SENT
    return rows.join(F.broadcast(goes) if few else goes, own, "left_anti").select(*docs.columns)


def _class_components(docs: DataFrame, signed: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    match = match_of(threshold)
    one = signed.select(F.col("rid").alias("cid"), "keys").join(classes.select("cid"), "cid")
    posted = one.select("cid", F.posexplode("keys").alias("c", "k"))
    shared = posted.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select("k")
    hits = stored(posted.join(shared, "k"), "hits")
    live = stored(hits.groupBy("cid").agg(F.count("*").alias("m")).filter(F.col("m") >= match).select("cid"), "live")
    if live.isEmpty():
        return classes.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0)
    sets = stored(_live_sets(docs, signed, classes, live), "sets")
    keys = stored(one.join(live, "cid"), "keys")
    single = sets.select("cid", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("m"), F.min("cid").alias("cid")).filter("m = 1")
    own = single.groupBy("cid").agg(F.count("*").alias("own"))
    about = sets.select("cid", F.size("items").alias("n")).join(own, "cid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    members = stored(hits.filter(F.col("c") <= COORDINATES - match).join(about, "cid").select("k", "c", "cid", "n", "own"), "members")

    # a member that can't reach the threshold with its list's best partner takes no part in that list
    rest = 100 - threshold
    best = members.groupBy("k").agg(F.min(F.struct("own", "cid")).alias("best"), F.count("*").alias("m")).filter("m > 1")
    met = members.join(best, "k").filter(rest * (F.col("n") - F.col("own")) >= threshold * (F.col("own") + F.col("best.own")))
    alive = stored(met.select("k", "c", "cid", "n", "own", F.col("best.cid").alias("centre")), "alive")
    links = stored(_verified(alive.filter("cid <> centre").select(F.col("cid").alias("a"), F.col("centre").alias("b")).distinct(), sets, keys, threshold), "links")

    # components of a list meet through their best members
    placed = _placed(alive, connected(links, "cc"), "placed")
    split = placed.groupBy("k").agg(F.min(F.struct("own", "cid", "root")).alias("best"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k", "best")
    heads = placed.groupBy("k", "root").agg(F.min(F.struct("own", "cid")).alias("head"))
    again = heads.join(split, "k").filter("root <> best.root").select(F.col("head.cid").alias("a"), F.col("best.cid").alias("b")).distinct()
    links = stored(links.unionByName(_verified(again.join(links, ["a", "b"], "left_anti"), sets, keys, threshold)), "links")

    # what is left: members of a centre's lists in different components
    group = alive.select("centre", "cid").distinct().join(connected(links, "cc").withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    split = group.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("centre")
    posted, sure = _differences(group.join(split, "centre"), sets, threshold)
    heads = posted.groupBy("centre", "item").agg(F.min_by(F.struct("cid", "n", "excess", "size", "d"), F.struct("excess", "cid")).alias("h")).select("centre", "item", "h.*")
    star = _close(posted.alias("x"), heads.alias("y"), threshold, F.col("x.cid") != F.col("y.cid"))
    links = stored(links.unionByName(_verified(sure.unionByName(star).distinct(), sets, keys, threshold)), "links")
    again = posted.join(connected(links, "cc").withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    again = stored(again, "apart")
    pairs = _close(again.alias("x"), again.alias("y"), threshold, (F.col("x.root") != F.col("y.root")) & (F.col("x.cid") < F.col("y.cid")))
    found = stored(links.unionByName(_verified(pairs.distinct(), sets, keys, threshold)), "links")
    return connected(found, "cc")


def _differences(group: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Postings (centre, item, cid, n, excess, size, d) of step 5 and the pairs (a, b) that are links for certain.

    A core has fewer items than two mean sets of its group, as each is in more than half of them.
    """
    have = stored(group.join(sets, "cid").select("centre", "cid", "items"), "have")
    sizes = group.groupBy("centre").agg(F.count("*").alias("m"))
    core = _by_centre(have.select("centre", F.explode("items").alias("item")).groupBy("centre", "item").agg(F.count("*").alias("f")), sizes, "item").filter("2 * f > m").groupBy("centre").agg(F.collect_list("item").alias("core"))
    both = _by_centre(have, core, "cid", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    apart = both.select("centre", "cid", F.size("items").alias("n"), F.concat(F.array_except("items", "core"), F.array_except("core", "items")).alias("d"))
    apart = stored(apart.withColumn("size", F.size("d")).withColumn("excess", (100 + threshold) * F.col("size") - (100 - threshold) * F.col("n")), "differences")
    least = apart.groupBy("centre").agg(F.min(F.struct("excess", "cid")).alias("least"))
    apart = _by_centre(apart, least, "cid")
    sure = apart.filter((F.col("excess") + F.col("least.excess") <= 0) & (F.col("cid") != F.col("least.cid"))).select(F.col("cid").alias("a"), F.col("least.cid").alias("b"))
    need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least.excess")) / (2 * (100 + threshold))))
    each = apart.select("centre", "cid", (F.col("size") - need + 1).alias("prefix"), F.explode("d").alias("item")).filter("prefix > 0")
    often = apart.select("centre", F.explode("d").alias("item")).groupBy("centre", "item").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("centre", "cid").orderBy("f", "item"))
    prefix = each.join(often, ["centre", "item"]).withColumn("place", place).filter("place <= prefix and f > 1").select("centre", "cid", "item")
    small = apart.select("centre", "cid", "n", "excess", "size", F.when(F.col("size") <= CARRIED, F.col("d")).alias("d"))
    return stored(prefix.join(small, ["centre", "cid"]), "postings"), sure


def _by_centre(rows: DataFrame, one: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """`rows` joined with the one row of its centre. Copies of that row, as many as its members have salts, spread a centre that many rows have."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return rows.join(one.join(rows.select("centre", "salt").distinct(), "centre"), ["centre", "salt"], how).drop("salt")


def _close(x: DataFrame, y: DataFrame, threshold: int, which: Column) -> DataFrame:
    """Pairs (a, b) of postings x and y of one item whose differences allow a link (where both are carried: that are one)."""
    shared = F.when(F.col("x.d").isNotNull() & F.col("y.d").isNotNull(), F.size(F.array_intersect("x.d", "y.d"))).otherwise(F.least("x.size", "y.size"))
    sized = 100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    linked = 2 * (100 + threshold) * shared >= F.col("x.excess") + F.col("y.excess")
    meet = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.item") == F.col("y.item"))
    return x.join(y, meet & which & sized & linked).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))


def _placed(alive: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    out = alive.select("k", "c", "cid", "n", "own").join(roots, alive.cid == roots.node, "left")
    return stored(out.select("k", "c", "cid", "n", "own", F.coalesce("root", "cid").alias("root")), name)


def _live_sets(docs: DataFrame, signed: DataFrame, classes: DataFrame, live: DataFrame) -> DataFrame:
    """Full sets of the classes that are left: texts meet the live doc_ids, and the hash of a set tells which class it is."""
    wanted = classes.join(live, "cid").select("cid", "h1", "h2")
    ids = stored(signed.join(live, signed.rid == live.cid, "left_semi").select("doc_id").distinct(), "live-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids.count() <= SENT:
        texts = _with_ids(texts, ids)
    else:
        texts = texts.alias("t").join(ids.alias("i"), F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    items = texts.mapInArrow(lean(_sets), "doc_id long, h1 long, h2 long, items array<long>").drop("doc_id")
    return items.join(wanted, ["h1", "h2"]).select("cid", "items").dropDuplicates(["cid"])


def _with_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id, null included, is among `ids`, which are counted to be at most SENT."""
    found = ids.toArrow().column("doc_id")
    null, known = found.null_count > 0, np.sort(found.drop_null().to_numpy())

    def run(batches):
        for batch in batches:
            doc = batch.column("doc_id")
            value = doc.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(known, value), len(known) - 1) if len(known) else np.zeros(len(value), int)
            here = known[at] == value if len(known) else np.zeros(len(value), bool)
            gone = doc.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(np.where(gone, null, here)))

    return texts.mapInArrow(run, "doc_id long, text string")
