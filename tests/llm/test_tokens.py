import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trialgrid.llm import common, packing, token_store

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def ids_of(path, texts, end):
    t = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def check_store(spark, docs):
    path = token_store.write_store(docs, BYTES)
    got = sorted(map(tuple, token_store.document_digests(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0]))
    ids = ids_of(BYTES, [r[1] for r in rows], 0)
    assert [r[0] for r in got] == [r[0] for r in rows]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert sorted((repr(r[0]), *r[2:]) for r in got) == sorted((repr(r[0]), len(i), crc(i)) for r, i in zip(rows, ids))
    back = {(r.doc_id, bytes(r.ids)) for r in token_store.read_ids(spark, path).collect()}
    assert back == {(r[0], np.array(i, "<u2").tobytes()) for r, i in zip(rows, ids)}
    return path


def test_store_round_trip(spark):
    path = check_store(spark, documents(spark))
    objects = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
    assert objects.count() == objects.select("key").distinct().count()
    top = spark.read.parquet(f"{path}/manifest").orderBy("level", ascending=False).first()
    assert (top.documents, top.n_ids) == tuple(spark.read.parquet(f"{path}/recipes").selectExpr("count(*)", "sum(n_ids)").first())


def test_store_odd_rows(spark, odd_documents, no_documents):
    check_store(spark, odd_documents)
    assert token_store.document_digests(spark, token_store.write_store(no_documents, BYTES)).count() == 0


def chunk_ends(ids):
    return token_store.chunk_ends(token_store.cut_places(ids).tolist(), 0, len(ids))


def test_chunks_follow_content():
    ids = np.random.RandomState(0).randint(0, 50000, 5000).astype("<u2")
    ends = chunk_ends(ids)
    assert ends[-1] == 5000 and max(np.diff([0, *ends])) <= token_store.CHUNK_MAX
    moved = chunk_ends(np.concatenate([ids[:10], ids]))
    assert len({e - 10 for e in moved} & set(ends)) > len(ends) // 2


def test_store_tells_of_damage(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 4)
    docs = documents(spark).limit(70)
    for damage in ("recipe", "chunk", "count"):
        path = token_store.write_store(docs, BYTES)
        assert token_store.document_digests(spark, path).count() == 70
        manifest = spark.read.parquet(f"{path}/manifest")
        assert manifest.filter("level = 4").count() == 1 and manifest.agg({"level": "max"}).first()[0] == 4
        table = {"recipe": "recipes", "chunk": "objects", "count": "manifest"}[damage]
        rows = spark.read.parquet(f"{path}/{table}")
        if damage == "recipe":
            less = rows.filter("place <> 33")
        elif damage == "chunk":
            less = rows.orderBy("kind", "key").offset(1)
        else:
            less = rows.selectExpr("level", "node", "documents + if(level = 1 and node = 3, 1, 0) as documents", "n_ids", "root")
        spark.createDataFrame(less.collect(), less.schema).write.mode("overwrite").parquet(f"{path}/{table}")
        with pytest.raises(Exception, match="manifest|missing"):
            token_store.document_digests(spark, path).collect()


def test_ids_of_odd_texts():
    rng = random.Random(1)
    parts = [" ", " ", "\n", "\t", "a", "b", "Z", "é", ".", "'", "s", "t", "ll", "1", "23", "!", "<|endoftext|>", "<|", "😀", "中", "e\u0301", "\x85", "\xa0", "\r\n", "\x1c", "\x00", "ſ", "İ", "Σ", "\u3000", "ñ", "\x7f", "\u212a", "re"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, "", "  ", "x" * 5000]
    for path in (BYTES, WORDS):
        coder, want = common.Encoder(path), ids_of(path, texts, 7)
        for _ in range(2):  # the second time from the cache
            got = []
            for row, ids, ends in coder.encode(pa.array(texts, pa.string()), 7):
                assert row == len(got)
                got += [x.tolist() for x in np.split(ids, ends[:-1])]
            assert got == want


def test_crc_shift():
    a, b = b"hello", b"x" * 1234567
    got = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
    assert int(got) == zlib.crc32(a + b)


def check_pack(docs):
    rows = docs.select("doc_id", "text").collect()
    ids = ids_of(WORDS, [r[1] for r in rows], 2)
    pieces = packing.pack(docs, WORDS).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    held = {}
    for p in pieces:
        assert len(p.ids) == 2 * p.length
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, spans in held.items():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist()
        assert sum(n for _, n in spans) == 4096 or s == max(held)
    whole = sorted((repr(r[0]), np.array(i, "<u2").tobytes()) for r, i in zip(rows, ids))
    placed = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    got, at = [], 0
    while at < len(placed):
        n, parts = placed[at].doc_tokens, []
        while n > 0:
            p = placed[at]
            assert p.start == sum(map(len, parts)) // 2
            parts.append(bytes(p.ids))
            n -= p.length
            at += 1
        got.append((repr(placed[at - 1].doc_id), b"".join(parts)))
    assert sorted(got) == whole


def test_pack_every_id_once(spark):
    check_pack(documents(spark))
    key = lambda p: (p.doc_id, p.start, p.length, p.sequence_id, p.offset)
    want = {key(p): crc(np.frombuffer(p.ids, "<u2")) for p in packing.pack(documents(spark), WORDS).collect()}
    assert {key(p): p.ids_crc32 for p in packing.pack(documents(spark), WORDS, digest=True).collect()} == want


def test_pack_odd_rows(spark, odd_documents, no_documents):
    check_pack(odd_documents)
    assert packing.pack(no_documents, WORDS).count() == 0


def test_hilbert_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_near_texts_are_near_on_the_curve(spark):
    rng = random.Random(5)
    topics = [[f"{chr(97 + t)}{rng.randint(0, 999)}" for _ in range(12)] for t in range(10)]
    texts = [(i, " ".join(rng.choice(topics[i % 10]) for _ in range(300))) for i in range(200)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), WORDS).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(p.doc_id % 10 for p in pieces)), [p.doc_id % 10 for p in pieces if p.start == 0]
    same = sum(a == b for a, b in zip(order[1], order[1][1:], strict=False)) / (len(order[1]) - 1)
    assert same > 0.6  # neighbours of a random order share their topic in a tenth of cases
