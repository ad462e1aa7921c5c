r"""Personal data by rules and a skip-chain conditional random field (operator 5).

Rules find emails, addresses, cards and phones (`base_spans`). The field's nodes are the tokens that carry a digit or `@`.
Neighbouring nodes share a chain potential; tokens that repeat or are similar (equal after case folding; of seven digits and more: equal
digits, of up to fifteen the same last seven, as a number with and without its prefix) share a skip potential, each with the last like token in a base span, or where there is none before it the first one, or in texts
without one the previous like token. So a labelled copy is one step from all others, and a document has fewer than two edges a
node. Loopy sum-product with damping, until the messages stay, gives marginals; a node outside base spans whose entity marginal reaches THRESHOLD is a span of the same kind, so that a
number written with `+` once is also found where it stands without.

Weights are rates over all documents, from counts gathered as one small table (shapes are a closed set), and don't change when
the corpus is repeated. A token outside base spans is unlabelled, not of label 0: it counts as a mixture of all labels (FREE).
Unary weights are log-rates of labels by shape. Chain and skip weights are log-ratios of label pairs with a smoothing in proportion.
Tokens that are told by their content (seven digits, or `@`) are of one kind wherever they stand: their skip weights come from the
rate at which labelled copies differ, at least DIFFER, and from the shape's own rates, so that what the shape tells counts once
and not with every copy. With these, one labelled copy outweighs the chain and a shape that base spans never have, while the
chain alone can't.

Null, empty and long texts are ordinary (null: no spans). Repeated rows get equal answers. Spans that overlap (ties of place) all stay in `find`
and become one in `redact`. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, SWEEPS, SETTLED, DAMPING, NEAR, SIMILAR = 0.9, 500, 1e-4, 0.3, 40, 7
#: Label shares of an unlabelled token; smoothing of pair rates; least rate at which copies of one number or address differ.
FREE, SMOOTH, DIFFER = np.array([0.99, *[0.01 / len(KINDS)] * len(KINDS)]), 0.01, 0.0005
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TELLING = re.compile("[0-9@]")
_TOKEN_END = re.compile(r"[^\s\"'<>,;]*")
_APART = frozenset("\"'<>,;")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start. Linear in the text but for runs of a single phone."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _shape(token: str) -> str:
    digits = len(_NOT_DIGIT.sub("", token))
    return f"{min(digits, 20)}|{min(token.count('.'), 4)}|{int('@' in token)}|{int(token[0] == '+')}|{int(any(c.isalpha() for c in token))}|{min(token.count('-'), 3)}"


def telling_tokens(text: str):
    """(start, end) of the runs without white space, quotes, angle brackets, commas and semicolons that hold a digit or `@`. Linear: no character is passed twice to the left."""
    last = 0
    m = _TELLING.search(text)
    while m:
        start = m.start()
        while start > last and not text[start - 1].isspace() and text[start - 1] not in _APART:
            start -= 1
        last = _TOKEN_END.match(text, m.start()).end()
        yield start, last
        m = _TELLING.search(text, last)


def graph(text: str, base: list[tuple[int, int, int]]):
    """Nodes (start, end, shape, label or 0), chain pairs, skip pairs told by content and other skip pairs of one document."""
    nodes, groups, chain, told, skip = [], {}, [], [], []
    spans = sorted((s, e, k) for k, s, e in base)
    at = 0
    for start, end in telling_tokens(text):
        token = text[start:end].rstrip(".:!?)")
        end = start + len(token)
        if not token:
            continue
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        near = at
        while near < len(spans) and spans[near][0] < end and spans[near][1] <= start:
            near += 1
        label = spans[near][2] + 1 if near < len(spans) and spans[near][0] < end else 0
        i = len(nodes)
        nodes.append((start, end, _shape(token), label))
        if i and start - nodes[i - 1][1] < NEAR:
            chain.append((i - 1, i))
        digits = _NOT_DIGIT.sub("", token)
        # similar numbers: with and without the prefix of a country or an exchange
        like = digits[-SIMILAR:] if 7 <= len(digits) <= 15 and "@" not in token else digits if len(digits) > 15 and "@" not in token else token.lower()
        groups.setdefault((like, "@" in token or len(digits) >= 7), []).append(i)
    for (_, content), group in groups.items():
        best = next((i for i in group if nodes[i][3]), None)
        for before, i in zip(group, group[1:]):
            if nodes[before][3]:
                best = before
            # ahead of the first labelled copy the edge belongs to the unlabelled one, so that each has one
            pair = (before, i) if best is None else (before, best) if i <= best else (best, i)
            (told if content else skip).append(pair)
    return nodes, chain, told, skip


def _tally(batches):
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            nodes, chain, told, skip = graph(text, base_spans(text))
            seen.update(("shape", n[2], n[3], 0) for n in nodes)
            for kind, pairs in (("chain", chain), ("told", told), ("skip", skip)):
                seen.update((kind, "", nodes[a][3], nodes[b][3]) for a, b in pairs)
    if seen:
        rows = [(*k, v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["what", "shape", "a", "b", "n"])


def train(docs: DataFrame) -> tuple[dict[str, np.ndarray], dict]:
    """Log rates by shape, log potentials of chain and skip edges, and (told) the rate at which labelled copies differ."""
    counts = docs.select("text").mapInArrow(lean(_tally), "what string, shape string, a int, b int, n long").groupBy("what", "shape", "a", "b").agg(F.sum("n").alias("n")).collect()
    return weights([tuple(r) for r in counts])


def weights(counts: list[tuple[str, str, int, int, int]]) -> tuple[dict[str, np.ndarray], dict]:
    n = len(KINDS) + 1
    share = np.eye(n)  # of a token by base label: that label, or a mixture
    share[0] = FREE
    shapes: dict[str, np.ndarray] = {}
    pairs = {"chain": np.zeros((n, n)), "skip": np.zeros((n, n))}
    both = differ = 0
    for what, shape, a, b, m in counts:
        if what == "shape":
            shapes.setdefault(shape, np.zeros(n))
            shapes[shape] += m * share[a]
        elif what != "told":
            pairs[what] += m * np.outer(share[a], share[b])
        elif a and b:
            both, differ = both + m, differ + m * (a != b)

    def lift(m: np.ndarray, most: float) -> np.ndarray:
        if not m.sum():
            return np.zeros((n, n))
        free = np.outer(FREE, FREE)
        p = (1 - SMOOTH) * m / m.sum() + SMOOTH * free
        return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -most, most)

    rate = DIFFER + (1 - DIFFER) * differ / max(both, 1)
    # a label never seen in a shape still has its share there
    unary = {k: np.log((1 - SMOOTH) * v / v.sum() + SMOOTH * FREE) for k, v in shapes.items()}
    return unary, {"chain": lift(pairs["chain"], 2), "told": rate, "skip": lift(pairs["skip"], 6)}


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Sum-product with damping until no message moves by SETTLED (SWEEPS at most, for loops that never do). edges (m, 2), pair (m, labels, labels) in logs."""
    m, n = len(edges), unary.shape[1]
    if not m:
        out = np.exp(unary - unary.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([pair, pair.transpose(0, 2, 1)])
    message, back = np.zeros((2 * m, n)), np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    for _ in range(SWEEPS):
        belief = unary.copy()
        np.add.at(belief, target, message)
        new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + potential, axis=1)
        new -= new.max(1, keepdims=True)
        new = DAMPING * message + (1 - DAMPING) * new
        moved = np.abs(new - message).max()
        message = new
        if moved < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    out = np.exp(belief - belief.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model) -> list[tuple[int, int, int]]:
    shapes, weight = model
    nodes, chain, told, skip = graph(text, base)
    if not (told or skip) or not any(n[3] for n in nodes):  # nothing that a distant token could tell
        return []
    unary = np.array([shapes.get(n[2], np.log(FREE)) for n in nodes])
    bare = np.array([not node[3] for node in nodes])
    ends = np.array(told, int).reshape(-1, 2)
    # the shape's rates: of the unlabelled end, or the mean of both
    part = bare[ends] / np.maximum(bare[ends].sum(1, keepdims=True), 1)
    own = np.exp((unary[ends] * part[:, :, None]).sum(1))
    own /= own.sum(1, keepdims=True)
    same = np.log((1 - weight["told"]) * np.eye(len(FREE)) / own[:, :, None] + weight["told"])
    for i, node in enumerate(nodes):
        if node[3]:
            unary[i] = -1e6  # more than all messages of many copies
            unary[i, node[3]] = 0.0
    edges = np.array(chain + told + skip)
    pair = np.concatenate([np.repeat(weight["chain"][None], len(chain), 0), same, np.repeat(weight["skip"][None], len(skip), 0)])
    p = marginals(unary, edges, pair)
    best = p[:, 1:].argmax(1)
    return [(int(best[i]), n[0], n[1]) for i, n in enumerate(nodes) if not n[3] and p[i, 1 + best[i]] >= THRESHOLD]


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame) -> DataFrame:
    """Columns of `docs` (but for clashing ones) with base and spans, arrays of (kind, start, end) by kind, then start."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = ("base", "spans")
    keep = docs.drop(*names)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + "".join(f", {n} {_SPAN}" for n in names)

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text or "")
                more = added_spans(text, own, model.value) if own else []
                for out, found in ((base, own), (spans, sorted([*own, *more]))):
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(spans, kind)], names=[*batch.schema.names, *names])

    return keep.mapInArrow(lean(run), schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each found span replaced by its kind in angle brackets."""
    model, keep = docs.sparkSession.sparkContext.broadcast(train(docs)), docs.schema

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                own = base_spans(text or "")
                texts.append(redacted(text, [*own, *added_spans(text, own, model.value)]) if own else text)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays(columns, names=keep.names)

    return docs.mapInArrow(lean(run), keep)


def digests(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
