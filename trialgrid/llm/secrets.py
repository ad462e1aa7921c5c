r"""Secret scan with multipart credential linking (operator 3), in DataFrame functions only.

Base spans (assignments, access identifiers, long hex runs) always stay. Weak candidates (an identifier assignment, a mixed
token, an endpoint) are reported only where a complementary part lies within SCOPE code points of them in the same document: an
identifier or endpoint needs a secret, a mixed token needs an identifier or an endpoint. Parts meet by an interval join: every
part is posted in the bins that its scope touches and joined by (document, bin), so that no document's parts are paired freely.

Positions come from one regular expression each: the pieces between matches and the matches, both in order, give running sums of
lengths in code points, added up by chunks of CHUNK matches, so that a text with many matches costs little more a match than one with few. Null counts as empty; equal rows are rows of their own; other columns are not read; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i:(?:client_?id|access_?key(?:_?id)?|user(?:name)?|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{4,})"""
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
BASE = ("assign", "access", "hex")
#: kind, pattern, role of the part
KINDS = (("assign", ASSIGN, "secret"), ("access", ACCESS, "id"), ("hex", HEX, "secret"), ("ident", IDENT, "id"), ("mixed", MIXED, "secret"), ("endpoint", ENDPOINT, "endpoint"))
SCOPE, CHUNK = 200, 256
_ORDER = {k: i for i, (k, _, _) in enumerate(KINDS)}


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _running(sizes: Column) -> Column:
    """Spans (start, end) of array elements (gap, size): running sums in chunks, so that the cost of appending stays with a chunk's length."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(s: Column, x: Column) -> Column:
        here = s["at"] + x["gap"]
        return F.struct((here + x["size"]).alias("at"), F.concat(s["spans"], F.array(F.struct(here.alias("start"), (here + x["size"]).alias("end")))).alias("spans"))

    def cut(x: Column) -> Column:
        chunk = lambda i: F.aggregate(F.slice(x, i * CHUNK + 1, F.lit(CHUNK)), F.struct(zero.alias("at"), none.alias("spans")), step)
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / CHUNK), F.lit(0)).cast("int")), chunk)

    def moved(local: Column) -> Column:
        ahead = F.aggregate(local, F.array(zero), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c["at"])))
        return F.flatten(F.zip_with(local, F.slice(ahead, F.lit(1), F.size(local)), lambda c, by: F.transform(c["spans"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end")))))

    return _let(_let(sizes, cut), moved)


def matches(text: Column, pattern: str, kind: str, least: tuple[int, int] | None = None) -> Column:
    """Array of (start, rank, kind, end) of the leftmost non-overlapping matches; least = (group, length) drops the others."""
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m).cast("long"))
    sizes = F.zip_with(_let(gaps, lambda g: F.slice(g, F.lit(1), F.size(g) - 1)), found, lambda p, m: F.struct(p.alias("gap"), m.alias("size")))
    spans = _running(sizes)
    if least:
        good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])), lambda g: F.length(g) >= least[1])
        spans = F.transform(F.filter(F.zip_with(spans, good, lambda x, g: F.struct(x.alias("x"), g.alias("g"))), lambda y: y["g"]), lambda y: y["x"])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(_ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (start, rank, kind, end) in that order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [matches(text, p, k, (2, 8) if k == "assign" else None) for k, p, _ in KINDS]
    found = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.concat(*parts)).alias("parts")), "secrets")
    role = F.create_map(*(F.lit(x) for k, _, r in KINDS for x in (k, r)))
    part = found.filter(F.exists("parts", lambda x: ~x["kind"].isin(*BASE)) & (F.size("parts") > 1)).select("rid", F.explode("parts").alias("p")).withColumn("role", role[F.col("p.kind")])
    bins = lambda lo, hi: F.explode(F.sequence((lo / SCOPE).cast("long"), (hi / SCOPE).cast("long")))
    # complementary parts: what is of interest there is only whether one lies near, so they are cut to one of a kind and bin end
    held = part.select("rid", "role", F.col("p.start").alias("s"), F.col("p.end").alias("e"), bins(F.col("p.start"), F.col("p.end")).alias("bin"))
    near = held.groupBy("rid", "bin", "role").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("e").alias("lo_end"), F.max("e").alias("hi_end"))
    # a weak candidate inside or across a base span says nothing new: the furthest end of the base spans that begin before its end is behind its start
    weak_kind = ~F.col("p.kind").isin(*BASE)
    order = Window.partitionBy("rid").orderBy(F.when(weak_kind, F.col("p.end")).otherwise(F.col("p.start")), F.when(weak_kind, 0).otherwise(1))  # of one text
    reach = F.max(F.when(~weak_kind, F.col("p.end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    free = part.withColumn("reach", F.coalesce(reach, F.lit(0))).filter(weak_kind & (F.col("reach") <= F.col("p.start")))
    weak = free.select("rid", "p", "role", bins(F.greatest(F.col("p.start") - SCOPE, F.lit(0)), F.col("p.end") + SCOPE).alias("bin"))
    pair = weak.alias("w").join(near.alias("n"), (F.col("w.rid") == F.col("n.rid")) & (F.col("w.bin") == F.col("n.bin")))
    fits = F.when(F.col("w.role") == "secret", F.col("n.role") != "secret").otherwise(F.col("n.role") == "secret")
    # in a bin: one that starts at or before the candidate ends latest at hi_end, one after starts first at lo
    close = (F.col("n.lo") <= F.col("w.p.end") + SCOPE) & (F.col("n.hi_end") >= F.col("w.p.start") - SCOPE)
    linked = pair.filter(fits & close).select("w.rid", "w.p").distinct().groupBy("rid").agg(F.collect_list("p").alias("linked"))
    base = F.filter("parts", lambda x: x["kind"].isin(*BASE))
    joined = found.join(linked, "rid", "left").withColumn("base", base)
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.filter("parts", lambda _: F.lit(False))))).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
