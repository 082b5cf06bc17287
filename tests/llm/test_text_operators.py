import hashlib
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import empty_like, messy_docs  # noqa: E402

from tidemark.llm import bpe_codec, seq_pack  # noqa: E402
from tidemark.llm.bpe_runs import encoder  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "á b é", "e\u0301 \u0301x", "ΣΑΣ ΟΔΟΣ.", "x<|endoftext|>y <|END", "it's I'LL don't'd", " a b\x1cc\x85d",
       "İstanbul ǅ", "1234 ½ ³", "a" * 3000, "à" * 2000 + " z", "日本語 テキスト。" * 100, "foo\x00bar", "<|startoftext|>" * 50,
       "ﬁ" * 10, "a\u00a0b\u2028c"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_runs_and_chunks_equal_the_tokenizer(plain):
    enc = bpe_codec.ChunkEncoder(PATH)
    long = " ".join(ODD * 3) + " " + "lorem ipsum dolor " * 500
    texts = ODD + [o + " " + long[:900] + o for o in ODD] + [long, long[7:], long]
    got = enc.encode_many([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        want = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert enc.base.decode(want).decode() == plain.decode(want, skip_special_tokens=False)


def test_chunks_are_content_defined():
    body = " ".join(f"word{i * 7919 % 1009}" for i in range(3000)).encode()
    a, b = bpe_codec.chunks(body), bpe_codec.chunks(b"something put in front " + body)
    assert b"".join(a) == body and len(a) > 20
    assert len(set(a) & set(b)) >= len(set(a)) - 3


def test_codec_query_on_awkward_rows(spark, plain):
    docs = messy_docs(spark)
    rows = bpe_codec.encode_decode(docs, PATH).collect()
    want = sorted((str(r.doc_id), plain.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert bpe_codec.encode_decode(empty_like(docs), PATH).count() == 0


def test_contract_digests_of_a_document(spark, plain):
    from tidemark.llm import queries
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op3_bpe_codec(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect():
        ids = plain.encode(r.text, add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def check_packing(pieces, ids_of, window):
    """Each id of each document in one piece, windows gapless, padding only at shard ends."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["key"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids_of)
    for key, ps in by_doc.items():
        ps.sort(key=lambda p: p["start"])
        want, at = ids_of[key], 0
        for p in ps:
            assert p["start"] == at and p["doc_tokens"] == len(want)
            part = np.frombuffer(p["ids"], "<u4").tolist()
            assert part == want[at:at + p["length"]]
            at += p["length"]
        assert at == len(want)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps])[:-1].tolist()
        assert sum(p["length"] for p in ps) <= window
    return by_seq


def test_packing_holds_every_id_once(spark, plain):
    docs = messy_docs(spark, repeat=False).where("doc_id is not null")
    ids_of = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for shard_bytes in (12_000_000, 40_000):
        out = seq_pack.pack_documents(docs, PATH, 256, 1, shard_bytes)
        seqs = check_packing([{**r.asDict(), "key": r.doc_id} for r in out.collect()], ids_of, 256)
        short = [s for s, ps in seqs.items() if sum(p["length"] for p in ps) < 256]
        assert len(short) <= len({s >> 32 for s in seqs})          # one padded window for each shard
    again = messy_docs(spark)
    total = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in again.collect())
    assert seq_pack.pack_documents(again, PATH).agg({"length": "sum"}).first()[0] == total
    assert seq_pack.pack_documents(empty_like(again), PATH).count() == 0


def test_bm25_scores_against_the_formula():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, int(rng.integers(1, 40))) for _ in range(30)]
    index = seq_pack.Bm25Index(docs)
    avg = np.mean([len(d) for d in docs])
    for seed in (0, 7, 19):
        got = index.query(seed, 1000)
        for j, d in enumerate(docs):
            want = 0.0
            for t in set(docs[seed].tolist()):
                df, tf = sum(t in x for x in docs), int((d == t).sum())
                want += np.log1p((30 - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(d) / avg))
            assert got[j] == pytest.approx(want, rel=1e-5)


def test_bm25_query_scores_every_term_of_a_long_seed():
    """The best neighbour shares only the seed's common terms, which are far from its heaviest."""
    rare, common = np.arange(1000, 1040), np.arange(100)
    docs = [np.concatenate([rare, common]), common, rare[:1]] + [np.concatenate([common[:50], [2000 + i]]) for i in range(30)]
    index = seq_pack.Bm25Index(docs)
    whole, some = index.query(0), index.query(0, 24)
    assert np.allclose(whole, index.query(0, 1000)) and (whole > 0).all() and whole[1] > whole[2] and some[1] == 0
    gone = np.zeros(len(docs), dtype=bool)
    gone[[0, 2, 5]] = True
    index.drop(gone)
    assert np.allclose(index.query(0), np.where(gone, 0, whole))


def test_packing_puts_related_documents_together():
    rng = np.random.default_rng(2)
    topics = [rng.integers(1000 * k, 1000 * k + 300, (8, 100)) for k in range(6)]
    docs = [topics[i % 6][i // 6] for i in range(48)]
    pieces = seq_pack.pack_shard(docs, 800)
    topics_in = {}
    for d, _, _, s, _ in pieces:
        topics_in.setdefault(s, set()).add(d % 6)
    assert np.mean([len(t) for t in topics_in.values()]) <= 2


def test_crc_of_pieces(spark):
    from tidemark.llm import queries
    sf = "/root/testdata/sf0.001"
    rows = queries.op8_packing(spark, sf).collect()
    enc = encoder(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows[:60]:
        ids = enc.encode_many([texts[r.doc_id].encode()])[0] + np.array([1], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)])
    filled = sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows}))
    assert filled > 0.97


def test_packing_keeps_large_ids_whole(spark):
    big = 2 ** 60
    docs = spark.createDataFrame([(big + 1, "a b"), (big + 2, "c"), (big + 3, None), (None, "d e")], "doc_id bigint, text string")
    assert {r.doc_id for r in seq_pack.pack_documents(docs, PATH).collect()} == {big + 1, big + 2, big + 3, None}


def test_plain_words_are_cut_as_the_tokenizer_does(plain):
    import random
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB'sSTdmMlLrReEvV09 .\"-!\t\nÉßÿÀ é'<|") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["it's I'LL don't'd 'super ''s '", "'", "a'", "'s", "'re've'll'm'd't's", "÷×", "x" * 100 + "'s"]
    for t, ids in zip(texts, encoder(PATH).encode_many([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_ranking_is_a_full_sort():
    rng = np.random.default_rng(3)
    for n in (0, 5, 200, 5000):
        score = rng.integers(0, 300, n).astype(np.float32)
        near = np.flatnonzero(score > 0)
        assert list(seq_pack.best_first(score)) == near[np.lexsort((near, -score[near]))].tolist()
