"""Ranked search, fill-in-the-middle and reversible line dedup against brute force over small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.llm import infill, lines, ranked

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


@pytest.fixture(params=["given", "odd", "none"])
def docs(request, spark, odd_documents, no_documents):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    return {"given": given, "odd": odd_documents, "none": no_documents}[request.param]


def texts(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


# --- 11 ---


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, bag, sum(bag.values())) for d, bag in bags if bag]
    n, length = len(bags), sum(size for *_, size in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, bag, size in bags:
            m = 10 + 90 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            scored += [(-score, d is None, d or 0)] if score > 0 else []
        out += [(item, rank, None if gone else d, -s) for rank, (s, gone, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("k, block", [(10, ranked.BLOCK_TERMS), (2, 40)])
def test_search(spark, docs, k, block):
    known = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    odd = [(900, None), (901, ""), (902, "... --"), (903, "The CAT sat; the cat"), (903, "The CAT sat; the cat"), (903, "word pass"), (None, "code ça ÉTÉ 😀"), (904, "zzzz-unknown"), (905, "river Ünï 20")]
    items = known.unionByName(spark.createDataFrame(odd, ITEMS)).withColumns({c: F.lit(1) for c in ("num", "a", "score", "block")})
    got = ranked.search(docs, items, k, block).select("item_id", "rank", "doc_id", "score").collect()
    same(got, brute_search(texts(docs), [tuple(r) for r in items.select("item_id", "text").collect()], k))


def test_no_items(spark, docs):
    assert ranked.search(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_ties_go_by_id_over_many_tasks(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 3 else f"other text {i}") for i in range(600, 0, -1)], "doc_id long, text string").repartition(7)
    got = ranked.search(docs, spark.createDataFrame([(1, "words here")], ITEMS)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14] and [r.rank for r in got] == [*range(1, 11)]


def test_accumulators_stop_where_bounds_are_too_small():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, count, k = int(rng.integers(1, 60)), int(rng.integers(1, 9)), int(rng.integers(1, 8))
        posts = [(np.sort(rng.choice(size, int(rng.integers(1, size + 1)), replace=False)), None) for _ in range(count)]
        posts = sorted(((d, rng.integers(1, 50, len(d))) for d, _ in posts), key=lambda p: len(p[0]))
        weights = np.sort(rng.integers(1, 30, count))[::-1]
        rest = np.cumsum([w * p[1].max() for w, p in zip(weights, posts, strict=True)][::-1])[::-1]
        full = np.zeros(size, int)
        for w, (d, x) in zip(weights, posts, strict=True):
            full[d] += w * x
        found, score = ranked.term_at_a_time(lambda t, p=posts: p[t], np.arange(count), weights, rest, size, k, 1)
        assert (full[found] == score).all()
        want = sorted(-x for x in full if x > 0)[:k]
        assert sorted(-score)[:k] == want


# --- 12 ---


def brute_infill(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, text
    spm = h[3] % 100 < 50
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc, n, "spm" if spm else "psm", len(prefix), len(middle), out


def test_infill(spark, docs):
    extra = [(100 + i, t) for i, t in enumerate(["\n", "\n\n", "a", "a\n", "\na", "<", "x <P> y\nz", "<S>", "a\n<M>\nb", "<\nP>\n<S\n>", "P>\n<", "é😀\nü\r\n\x0b x\n" * 50, "x\n" * 5000])]
    rows = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("n", "h1", "form")]).unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "h1", "form")}))
    moved = infill.fill_in_middle(rows)
    want = [brute_infill(*r) for r in texts(rows)]
    same(moved.collect(), want)
    same(infill.restore(moved).collect(), [(d, t or "") for d, t in texts(rows)])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    same(infill.digests(moved).collect(), [(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, texts(rows), strict=True)])


def test_infill_rates_and_small_slices(spark, docs, monkeypatch):
    assert {r.form for r in infill.fill_in_middle(docs, rate=0).select("form").distinct().collect()} <= {"plain"}
    assert {r.form for r in infill.fill_in_middle(docs, spm_rate=100).select("form").distinct().collect()} <= {"plain", "spm"}
    monkeypatch.setattr(infill, "_AT_ONCE", 50)
    same(infill.restore(infill.fill_in_middle(docs)).collect(), [(d, t or "") for d, t in texts(docs)])


# --- 13 ---


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(docs, least, chars=1, counted=None):
    held = Counter(k for _, t in (docs if counted is None else counted) for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for doc, text in docs:
        rows = (text or "").split("\n")
        kept = [x for x in rows if len(key(x)) < chars or held[key(x)] < least]
        out.append((doc, len(rows), len(rows) - len(kept), "\n".join(kept)))
    return out


ODD_LINES = [(200 + i, t) for i, t in enumerate(["\n", " \n\t", "A b \n a B\n\nA  b", "x\n\x0bA B\x0c\r\ny", "é\nÉ\n é", "a b\n", "\na b", "a b", "a b\n a b", "😀 \nü"])]


@pytest.fixture
def with_lines(spark, docs):
    rows = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("a", "b", "docs", "rid", "at", "kept")])
    return rows.unionByName(spark.createDataFrame(ODD_LINES, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "b", "docs", "rid", "at", "kept")}))


@pytest.mark.parametrize("least, chars", [(10, 1), (2, 1), (2, 3), (1, 2)])
def test_lines(with_lines, least, chars):
    index = lines.LineIndex.build(with_lines, least, chars)
    want = brute_lines(texts(with_lines), least, chars)
    same(index.clean(with_lines).collect(), want)
    same(index.clean(with_lines, filter_bytes=0).collect(), want)


def test_empty_tables(spark, no_documents):
    index = lines.LineIndex.build(no_documents)
    assert index.clean(no_documents).count() == 0 and index.refs.count() == 0
    rows = spark.createDataFrame(ODD_LINES, "doc_id long, text string")
    same(index.clean(rows).collect(), brute_lines(ODD_LINES, 10, counted=[]))


def counts(index):
    return {(r.a, r.b): r.docs for r in index.refs.collect()}


def test_inserts_and_deletions_are_reversible(spark, with_lines, tmp_path):
    rows = with_lines.select("doc_id", "text").withColumn("half", F.pmod(F.hash("text"), F.lit(2)))
    one, two = rows.filter("half = 0"), rows.filter("half = 1")
    first = lines.LineIndex.build(one, 2)
    both = first.insert(two)
    same(both.clean(rows).collect(), brute_lines(texts(rows), 2))
    whole = lines.LineIndex.empty(spark, 2).insert(rows)
    assert counts(whole) == counts(both)
    back = both.delete(two)
    assert counts(back) == counts(first)
    assert (back.cells() > 0).sum() == back.common().count() == first.common().count()  # nothing of the deleted documents stays in the filters
    same(back.clean(one).collect(), brute_lines(texts(one), 2))
    same(back.clean(rows).collect(), brute_lines(texts(rows), 2, counted=texts(one)))  # also documents that aren't in the index
    both.save(str(tmp_path / "index"))
    same(lines.LineIndex.open(spark, str(tmp_path / "index")).clean(rows).collect(), brute_lines(texts(rows), 2))
    gone = back.delete(one)
    assert gone.refs.count() == 0 and not gone.cells().any()
    with pytest.raises(ValueError):
        gone.delete(spark.createDataFrame([(1, "never seen")], "doc_id long, text string"))


def test_false_positives_are_confirmed(spark):
    """With fingerprints of one bit and few buckets most keys pass the filters; results stay exact."""
    rows = spark.createDataFrame([(i, f"line {i}\nshared {i % 20}\nonly {i * 7}") for i in range(60)], "doc_id long, text string")
    for part in (rows.filter("doc_id % 20 < 4"), rows):
        index = lines.LineIndex.build(part, 2, buckets=8, bits=1)
        same(index.clean(rows).collect(), brute_lines(texts(rows), 2, counted=texts(part)))


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    b = rng.integers(0, 1 << 63, 48_000).astype(np.uint64)
    cells = np.zeros((lines.BUCKETS, lines.SLOTS), "<u2")
    assert lines.cuckoo_insert(cells, b[:40_000]) and lines.cuckoo_insert(cells, b[40_000:])
    assert (cells > 0).sum() == 48_000
    has = lambda i, j: lines.cuckoo_has(cells[None], np.zeros(j - i, int), b[i:j])
    assert has(0, 48_000).all()
    lines.cuckoo_delete(cells, b[:20_000])
    assert has(20_000, 48_000).all() and has(0, 20_000).mean() < 0.01
    lines.cuckoo_delete(cells, b[20_000:])
    assert not cells.any()
    assert not lines.cuckoo_insert(cells, rng.integers(0, 1 << 63, 70_000).astype(np.uint64), rounds=200)  # more than there are cells


def test_more_shards_where_one_is_full(spark):
    rows = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i % 2, 900, 2))) for i in range(6)], "doc_id long, text string")
    index = lines.LineIndex.build(rows.filter("doc_id < 4"), 2, buckets=64)
    assert index.shards > 4
    more = index.insert(rows.withColumn("text", F.concat("text", F.lit("\nnew"))))
    same(more.clean(rows).collect(), brute_lines(texts(rows), 2))
    small = lines.LineIndex.build(rows.filter("doc_id = 0"), 2, buckets=64).insert(rows)  # one shard to begin with
    assert small.shards > 4
    same(small.clean(rows).collect(), brute_lines(texts(rows), 2))


def test_long_texts(spark):
    long = [(1, "same line\n" * 200_000), (2, "x" * 3_000_000 + "\nsame line"), (3, "\n" * 500_000), (4, "Same Line \n" * 3)]
    rows = spark.createDataFrame(long, "doc_id long, text string")
    same(lines.LineIndex.build(rows, 3).clean(rows).collect(), brute_lines(long, 3))
    same(infill.fill_in_middle(rows).collect(), [brute_infill(*r) for r in long])
    same(ranked.search(rows, spark.createDataFrame([(1, "same line")], ITEMS)).select("item_id", "rank", "doc_id", "score").collect(), brute_search(long, [(1, "same line")], 10))
