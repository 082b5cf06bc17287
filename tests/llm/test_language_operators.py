"""Language-model scores, spelling variants and collocations against brute force."""

import math
import os
import random
import re
import sys
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import empty_like, messy_docs  # noqa: E402

from tidemark.llm import collocations as C  # noqa: E402
from tidemark.llm import ngram_lm as L  # noqa: E402
from tidemark.llm import spelling as S  # noqa: E402
from tidemark.llm.elias_fano import EliasFano  # noqa: E402
from tidemark.llm.text_hash import mix  # noqa: E402
from tidemark.llm.word_blocks import byte_set, entries, make_block, pack_ints, unpack_ints, unpack_sorted  # noqa: E402

SF = "/root/testdata/sf0.001"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# ---- blocks and Elias-Fano ----

def test_blocks_number_words_breaks_and_ends():
    rng = random.Random(1)
    sep, brk = byte_set(b" \t", b".\n"), byte_set(b".\n")
    for _ in range(300):
        parts = ["".join(rng.choice("aB c.\n") for _ in range(rng.randint(0, 12))).encode() for _ in range(3)]
        closed = [rng.random() < 0.7 for _ in parts]
        b = make_block(parts, sep, brk, closed)
        words, got = b.words.to_pylist(), []
        want, sizes = [], []
        for p, c in zip(parts, closed):
            pieces = [re.findall("[^ \t]+", x) for x in re.split("[.\n]", p.lower().decode())]
            row = []
            for x in filter(None, pieces):
                row += ([""] if row else []) + x
            row += [""] if c else []
            want += row
            sizes.append(len(row))
        got = ["" if i == 0 else words[i - 1].decode() for i in b.numbers.tolist()]
        assert (got, b.sizes.tolist()) == (want, sizes)


def test_long_texts_are_cut_between_words_and_carry_context():
    rng, sep = random.Random(2), byte_set(b" ")
    for _ in range(300):
        raw = "".join(rng.choice("ab  ") for _ in range(rng.randint(0, 60))).encode()
        parts, seen = list(entries(raw, sep, 7)), []
        for part, lead, _ in parts:
            words = part.split()
            assert words[:lead] == seen[len(seen) - lead:]
            seen += words[lead:]
        assert seen == raw.split() and [p[2] for p in parts] == [False] * (len(parts) - 1) + [True]


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (1, 1 << 50), (5, 5), (1000, 3000), (70_000, 1_000_000),
                                        (66_000, 1 << 33)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(1)
    values = np.arange(n) if n == universe else np.unique(rng.integers(0, universe, n))
    coded = EliasFano(b"12345678" + EliasFano.build(values, universe), 8)
    assert np.array_equal(coded.access(np.arange(len(values))), values)
    assert np.array_equal(coded.find(values), np.arange(len(values)))
    probe = rng.integers(0, universe, 3000)
    assert np.array_equal(coded.find(probe) >= 0, np.isin(probe, values))


def test_integers_survive_packing():
    for a in ([], [0], [0, 0], [1 << 63, 5], list(range(1000))):
        assert unpack_ints(pack_ints(np.array(a, dtype=np.uint64))).tolist() == a


# ---- language model ----

def brute_scores(rows, held, node_of=lambda u, v: v):
    """(n_tokens, n_known, N, base, score) of every row, by plain counting."""
    tokens = [re.findall("[^\x20\x09-\x0D]+", lower(t or "")) + [""] for t in rows]
    c1, c2, c3, cv, cc = (Counter() for _ in range(5))
    for h, w in zip(held, tokens):
        if h:
            continue
        c1.update(w)
        for k in range(1, len(w)):
            u = w[k - 2] if k > 1 else None
            v = node_of(u, w[k - 1])
            c2[v, w[k]] += 1
            cv[v] += 1
            if k > 1:
                c3[u, v, w[k]] += 1
                cc[u, v] += 1
    n, types = sum(c1.values()), len(c1)
    out = []
    for w in tokens:
        base = score = 0.0
        for k, x in enumerate(w):
            p = (c1[x] + 0.1) / (n + 0.1 * (types + 1))
            base += math.log10(p)
            if k:
                u = w[k - 2] if k > 1 else None
                v = node_of(u, w[k - 1])
                p = (c2[v, x] + L.M2 * p) / (cv[v] + L.M2)
                if k > 1:
                    p = (c3[u, v, x] + L.M3 * p) / (cc[u, v] + L.M3)
            score += math.log10(p)
        out.append((len(w), sum(c1[x] > 0 for x in w), n, base, score))
    return out


def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def held_of(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def check_scores(got, docs, want):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = sorted((str(i), held_of(i), *w) for (i, _), w in zip(docs, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert b[6] - 6e-4 * a[2] <= a[6] <= b[6] + 1e-6            # three roundings down of up to 1/4096


def test_scores_equal_plain_counts(spark):
    docs = messy_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_scores([t for _, t in rows], [held_of(i) for i, _ in rows])
    check_scores(L.score_texts(docs, held()).collect(), rows, want)
    small = L.score_texts(docs, held(), block_bytes=3000, shard_words=50, shard_positions=10_000)
    check_scores(small.collect(), rows, want)
    assert L.score_texts(empty_like(docs), held()).count() == 0


def test_long_texts_in_several_entries_score_the_same(spark, monkeypatch):
    """Parts of a text share one row and keep their context; plain function, as tasks see their own module."""
    text = " ".join(f"w{i % 50}" for i in range(3000))
    whole, cuts = [(text.encode(), 0, True)], list(entries(text.encode(), L.SEPARATORS, 1000))

    def row(parts):
        b = make_block([p for p, _, _ in parts], L.SEPARATORS, None, [c for _, _, c in parts])
        return L._Positions({"numbers": pack_ints(b.numbers), "sizes": pack_ints(b.sizes),
                             "lead": pack_ints(np.array([x for _, x, _ in parts])),
                             "held": pack_ints(np.zeros(len(parts)))}), b.words.to_pylist()

    (p, pw), (q, qw) = row(whole), row(cuts)
    assert len(cuts) > 5
    names = [[b""] + w for w in (pw, qw)]
    trigrams = [[tuple(n[x] for x in z.numbers[max(i - min(k, 2), 0):i + 1]) for i, k in zip(z.at, z.inside)]
                for z, n in zip((p, q), names)]
    assert trigrams[0] == trigrams[1]


def test_frequent_contexts_are_told_apart_by_the_word_before(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the"] * 6 + list("abcdef")) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tries = L.build_tries(docs, held(), node_count=200, shard_positions=500).collect()
    # numbers as the query gives them: one vocabulary shard, by count descending, then bytes
    counts = Counter(w for i, t in rows if not held_of(i) for w in t.split() + [""])
    number = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())))}

    def node_of(u, v):
        k = max(-(-counts[v] // 200), 1)
        return v, int(mix(np.array([0 if u is None else number[u] + 1], dtype=np.uint64))[0]) % k

    nodes = {node_of(u, v) for i, t in rows for u, v in zip([None] + t.split(), t.split())}
    assert sum(len(unpack_sorted(r.nodes)) for r in tries) == len(nodes) and len(tries) > 2
    want = brute_scores([t for _, t in rows], [held_of(i) for i, _ in rows], node_of)
    check_scores(L.score_texts(docs, held(), node_count=200, shard_positions=500).collect(), rows, want)


def test_trie_is_read_from_a_mapped_file_and_sums_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tries = L.build_tries(docs, held(), shard_positions=20_000).collect()
    assert len(tries) > 3
    r = max(tries, key=lambda r: len(r.trie))
    with tempfile.NamedTemporaryFile(suffix=".trie") as f:
        f.write(r.trie)
        f.flush()
        trie = L.NgramTrie(np.memmap(f.name, dtype=np.uint8, mode="r"))
        counts = unpack_ints(r.counts).astype(np.int64)
        log1 = np.log10((counts + 0.1) / (counts.sum() + 0.1 * (len(counts) + 1)))
        words = np.arange(trie.n_words)
        for node in range(0, min(trie.n_nodes, 40), 4):
            for before in (-1, 0, 5):
                log = trie.score(log1, np.full(len(words), node), np.full(len(words), before), words)
                assert (10.0 ** log).sum() <= 1.001      # p1 here is of this shard's words alone
        plain = L.NgramTrie(r.trie)
        at = np.arange(trie.n_words)
        assert np.array_equal(plain.score(log1, at % trie.n_nodes, at - 1, at), trie.score(log1, at % trie.n_nodes, at - 1, at))


def test_query_beats_its_base_on_held_out_texts(spark):
    from tidemark.llm import queries
    rows = queries.op11_lm_scoring(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_scores(rows, docs, brute_scores([t for _, t in docs], [held_of(i) for i, _ in docs]))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


# ---- spelling ----

def brute_words(rows):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def brute_variants(words, factor=10):
    near = defaultdict(set)
    gaps = defaultdict(set)
    for x in words:
        for i in range(len(x)):
            gaps[x[:i], x[i + 1:]].add(x)
            y = x[:i] + x[i + 1:]
            if y in words:
                near[x].add(y)
                near[y].add(x)
    for g in gaps.values():
        for x in g:
            near[x] |= g - {x}
    form = {}
    for x, n in words.items():
        best = min(((-words[y], y) for y in near[x]), default=(0, None))
        form[x] = best[1] if best[1] is not None and -best[0] >= factor * n else None
    out = []
    for x, n in words.items():
        root = x
        while form[root] is not None:
            root = form[root]
        out.append((x, form[x], root, n, len(near[x]), words.get(form[x])))
    return sorted(out, key=str)


def variant_rows(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_variants_equal_all_pairs(spark):
    rng = random.Random(11)
    words = {}
    for _ in range(700):                      # few letters and runs of them: many neighbours, many ties
        words["".join(rng.choice("abbà") for _ in range(rng.randint(0, 7)))] = 10 ** rng.randint(0, 7)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = brute_variants(words)
    for kw in ({}, {"part_words": 23, "shard_pairs": 200}):
        assert variant_rows(S.variant_groups(df, **kw)) == want
    assert any(r[1] is not None and r[2] != r[1] for r in want)      # ways of several hops


def test_variants_of_documents(spark):
    docs = messy_docs(spark).unionByName(messy_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_variants(brute_words(rows))
    assert variant_rows(S.spelling_variants(docs)) == want and want
    assert S.spelling_variants(empty_like(docs)).count() == 0


def test_variant_query(spark):
    from tidemark.llm import queries
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert variant_rows(queries.op12_spelling_variants(spark, SF)) == brute_variants(brute_words(rows))


# ---- collocations ----

def brute_collocations(rows, min_count=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        rows_ = []
        for p, a in candidates.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items() if len(p) == 2):
                continue
            s, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((s, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)]
    return sorted(out)


def phrase_docs(spark):
    rng = random.Random(8)
    words = ["New", "york", "de", "la", "été", "x.y", "a", "b", "c d", "München"]
    rows = [(i, rng.choice(["en", "fr", None, ""]),
             rng.choice([". ", " ", "\t"]).join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(150)]
    rows += [(500, "en", None), (501, None, ""), (502, "en", "aa " * 3000), (502, "en", "aa " * 3000), (None, "fr", "de la " * 40)]
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("z"))


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 2000, "shard_grams": 500}, {"bits": 7}, {"bits": 7, "block_bytes": 900}])
def test_collocations_equal_plain_counts(spark, kw):
    """Seven-bit fingerprints collide everywhere; the counts by text put that right."""
    docs = phrase_docs(spark)
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()])
    assert want
    assert sorted(tuple(r) for r in C.collocations(docs, **kw).collect()) == want


def test_collocations_top_and_empty(spark):
    docs = phrase_docs(spark)
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()], min_count=3, top=5)
    assert sorted(tuple(r) for r in C.collocations(docs, min_count=3, top=5).collect()) == want
    assert C.collocations(empty_like(docs)).count() == 0
    assert C.collocations(messy_docs(spark)).count() > 0


def test_score_is_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10 ** 12 + 1, 3 * 10 ** 12 + 7, 5 * 10 ** 12 + 11)], "a bigint, l bigint, r bigint")
    a, l, r = row.first()
    assert row.select(F.expr(C.SCORE).alias("s")).first().s == 1000000 * a * a // (l * r)
