r"""Benchmark decontamination by a prefix-filtered set join over item-sized windows (operator 6), in DataFrame functions only.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z. A window is 10 consecutive words of an item, or all words of a
shorter one. Shingles are pairs of neighbouring words (single words for items of one).

1. One pass over the documents keeps the shingles that any window has, with their positions, and counts them.
2. Each window's shingles are ordered by rarity in the documents; its necessary prefix under containment is the rarest one.
   Only places of that shingle are candidates; its place in the window gives where the window would have to start, which has to
   lie inside the document with room for the whole window (positional and length bound).
3. A candidate is confirmed when all the window's shingles stand at their places: pairs that overlap by a word spell the window.

The set of window shingles is broadcast only if counted to be at most BROADCAST_ROWS, else it is joined by shuffle. Null texts
have no words; repeated rows are rows of their own; other columns are not read; no items or no rows give clean or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import free_name, numbered, scratch, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, BROADCAST_ROWS = 10, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win, w): the window's words joined by one space, and as an array."""
    found = items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("i")
    return found.select("item_id", "w", starts).select("item_id", F.expr(f"slice(w, i + 1, {size})").alias("w")).select("item_id", F.array_join("w", " ").alias("win"), "w").distinct()


def _shingles(w: Column) -> Column:
    """Pairs of neighbouring words by place; the pair of the last word is null."""
    return F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rows (rid, doc_id, w), windows (item_id, win, w) and all places (rid, win, start, n) of windows in documents."""
    return _occurrences(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__rid")), items, size)


def _occurrences(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`occurrences` in rows with a number `__rid`."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, size), "windows")
    base = stored(docs.select(F.col("__rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")), "words")
    once = windows.select("win", "w").dropDuplicates(["win"])
    singles = windows.filter("size(w) = 1").limit(1).count() > 0
    keyed = once.select("win", F.size("w").alias("n"), F.posexplode(F.when(F.size("w") == 1, F.col("w")).otherwise(_shingles(F.col("w")))).alias("at", "key")).filter("key is not null")
    keyed = stored(keyed, "window-shingles")
    keys = stored(keyed.select("key").distinct(), "keys")
    spread = base.select("rid", F.posexplode(_shingles(F.col("w"))).alias("pos", "key"))
    if singles:
        spread = spread.unionByName(base.select("rid", F.posexplode("w").alias("pos", "key")))
    small = keys.count() <= BROADCAST_ROWS
    hits = stored(spread.join(F.broadcast(keys) if small else keys, "key", "left_semi").select("rid", "pos", "key"), "hits")
    counts = hits.groupBy("key").agg(F.count("*").alias("seen"))
    ranked = keyed.join(counts, "key")  # a window with a shingle that no document has can't occur
    prefix = ranked.groupBy("win", "n").agg(F.min(F.struct("seen", "key", "at")).alias("rare"), F.count("*").alias("known"))
    prefix = prefix.filter(F.col("known") == F.greatest(F.col("n") - 1, F.lit(1))).select("win", "n", "rare.key", "rare.at")
    prefix = stored(prefix, "prefixes")
    few = prefix.count() <= BROADCAST_ROWS
    met = hits.join(F.broadcast(prefix) if few else prefix, "key").select("rid", "win", "n", (F.col("pos") - F.col("at")).alias("start"))
    fit = met.join(base.select("rid", F.size("w").alias("n_words")), "rid").filter("start >= 0 and start + n <= n_words").select("rid", "win", "n", "start")
    candidates = stored(fit, "candidates")
    places = keyed.select("win", "at", "key")
    wanted = candidates.join(F.broadcast(places) if small and places.count() <= BROADCAST_ROWS else places, "win").select("rid", "win", "n", "start", (F.col("start") + F.col("at")).alias("pos"), "key")
    proven = wanted.join(hits, ["rid", "pos", "key"]).groupBy("rid", "win", "n", "start").agg(F.count("*").alias("m"))
    return base, windows, proven.filter(F.col("m") == F.greatest(F.col("n") - 1, F.lit(1))).select("rid", "win", "n", "start")


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base, windows, found = occurrences(docs, items, size)
    found = stored(found, "found")
    spans = found.select("rid", "start", "n").distinct()
    hit = spans.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = windows.filter("item_id is not null").select("win", F.col("item_id").cast("string").alias("item_id"))
    held = found.select("rid", "win").distinct().join(names, "win").select("rid", "item_id").distinct()
    items_of = held.groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("held"))
    out = base.select("rid", "doc_id", F.size("w").cast("long").alias("n_words")).join(hit, "rid", "left").join(items_of, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("held"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("held", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of `docs` in which no item window occurs."""
    own = free_name(docs, "__rid")
    rows = numbered(docs, own, "rows")
    with scratch(docs.sparkSession) as kept:
        _, _, found = _occurrences(rows.select(F.col(own).alias("__rid"), "doc_id", "text"), items, size)
        bad = kept(found.select(F.col("rid").alias(own)).distinct(), "contaminated")
    few = bad.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(bad) if few else bad, own, "left_anti").select(*docs.columns)


#: The same rows in SQL, by whole windows.
ORACLE = r"""
with dw as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, array_to_string(w[i + 1:i + 10], ' ') as win, least(len(w), 10) as n from bw, unnest(range(0, greatest(len(w) - 10, 0) + 1)) t(i) where len(w) > 0),
sizes as (select distinct n from win),
dwin as (select rid, n, i, array_to_string(w[i + 1:i + n], ' ') as win from dw, sizes, unnest(range(0, len(w) - n + 1)) t(i)),
hits as (select d.rid, d.i, d.n, win.item_id from dwin d join win on d.win = win.win and d.n = win.n),
covered as (select rid, count(distinct i + k) as n_hit from hits, unnest(range(0, n)) t(k) group by rid),
names as (select rid, list(distinct item_id::varchar order by item_id::varchar) as held from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(held), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(held, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (rid) left join names using (rid)
"""
