import collections
import hashlib
import itertools
import os
import random
import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import empty_like, messy_docs, shingles, words_of  # noqa: E402

from tidemark.llm import exact_dedup, jaccard_join  # noqa: E402
from tidemark.llm.components import components  # noqa: E402
from tidemark.llm.exact_dedup import CuckooFilter  # noqa: E402


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=600))
@settings(max_examples=25, deadline=None)
def test_cuckoo_filter_follows_a_set(steps):
    f, live = CuckooFilter(4), set()
    for add, i in steps:
        key = hashlib.sha256(str(i).encode()).digest()
        if add and key not in live:
            f.insert(key, [1, i])
            live.add(key)
        elif not add and key in live:
            f.delete(key)
            live.remove(key)
        assert (f.get(key) is not None) == (key in live)
    assert all(f.maybe(k) for k in live) and set(f.keys) == live


def test_cuckoo_filter_resizes_from_stored_keys():
    f = CuckooFilter(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        f.insert(k, [1, i])
    assert f.resizes > 0 and all(f.get(k) == [1, i] for i, k in enumerate(keys))
    wrong = sum(f.maybe(hashlib.sha256(f"other{i}".encode()).digest()) for i in range(5000))
    assert wrong < 25 and f.get(hashlib.sha256(b"other").digest()) is None


def test_index_insert_and_delete(spark):
    d = [hashlib.sha256(str(i).encode()).digest() for i in range(6)]
    schema = "digest binary, n bigint, max_id bigint"
    index = exact_dedup.update_index(exact_dedup.empty_index(messy_docs(spark)),
                                     spark.createDataFrame([(d[0], 2, 9), (d[1], 1, 4), (d[2], 1, None)], schema), 2)
    changes = spark.createDataFrame([(d[0], -1, None), (d[1], -1, None), (d[3], 3, 30), (d[2], 1, 8),
                                     (d[4], -1, None)], schema)
    rows = {bytes(r.digest): (r.n, r.max_id) for r in exact_dedup.update_index(index, changes, 2).collect()}
    assert rows == {d[0]: (1, 9), d[2]: (2, 8), d[3]: (3, 30)}


def test_exact_groups_against_brute_force(spark):
    docs = messy_docs(spark)
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    want = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((str(r.doc_id), str(keep), len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.digest) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(got) == sorted(want)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    out = [(r.doc_id, r.text or "") for r in left.collect()]
    assert len(out) == len(groups) and {t for _, t in out} == set(groups)
    assert exact_dedup.exact_groups(empty_like(docs)).count() == 0
    assert exact_dedup.drop_copies(empty_like(docs)).count() == 0


def brute_links(rows):
    """Class, copies and links by comparing every pair."""
    seq = collections.defaultdict(list)
    for i, t in rows.items():
        seq[tuple(words_of(t)) or ("", i)].append(i)
    rep = {i: min(v) for v in seq.values() for i in v}
    grams = {r: shingles(rows[r]) for r in set(rep.values())}
    links = collections.Counter()
    parent = {r: r for r in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(grams), 2):
        both = len(grams[a] & grams[b])
        if both and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(rep[i]), rep[i], len(seq[tuple(words_of(rows[i])) or ("", i)]), links[rep[i]]) for i in rows}


def test_near_duplicates_on_awkward_rows(spark):
    docs = messy_docs(spark)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_links(rows)
    assert got[6][0] == got[7][0] == 6 and got[12][1] == 11
    assert jaccard_join.near_duplicates(empty_like(docs)).count() == 0
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2


def test_near_duplicates_of_ids_with_several_texts(spark):
    """No text of a shared or missing id is lost, and no text goes because another of its id does."""
    words = [[f"{c}{i}" for i in range(100)] for c in "abcdef"]

    def text(k, *changed):
        return " ".join("new" if i in changed else w for i, w in enumerate(words[k]))
    rows = [(1, text(0)), (5, text(0, 3)), (5, text(1)), (5, text(2)), (9, text(2, 50)), (9, text(0, 99)),
            (None, text(1, 7)), (None, text(3)), (None, text(3, 1)), (20, text(4)), (20, text(4).upper()),
            (20, text(4)), (21, text(5)), (None, text(5)), (30, None), (30, "!"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links, r.n_words)
           for r in jaccard_join.near_classes(docs).collect()}
    assert got == {(1, 1, 1, 1, 2, 100), (5, 1, 5, 1, 2, 100), (9, 1, 9, 1, 2, 100), (5, 5, 5, 1, 1, 100),
                   (None, 5, None, 1, 1, 100), (9, 5, 9, 1, 1, 100), (None, None, None, 1, 1, 100),
                   (20, 20, 20, 1, 0, 100), (21, 21, 21, 2, 0, 100), (None, 21, 21, 2, 0, 100),
                   (30, 30, 30, 1, 0, 0), (None, None, None, 1, 0, 0)}
    left = [(r.doc_id, (r.text or "").lower()) for r in jaccard_join.keep_representatives(docs).collect()]
    nameless = [t for i, t in left if i is None and t]
    assert len(nameless) == 1 and nameless[0] in (text(3), text(3, 1))
    assert sorted((i, t) for i, t in left if i is not None) == sorted(
        [(1, text(0)), (5, text(1)), (5, text(2)), (20, text(4)), (21, text(5)), (30, ""), (30, "!")])
    assert left.count((None, "")) == 1


def test_near_duplicates_in_a_large_group(spark):
    """Hundreds of edited copies span several blocks; no link and no class is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(420):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"v{rng.randrange(10_000)}"
        rows[i] = " ".join(w)
    for i in range(420, 470):
        rows[i] = " ".join(base[:30] + [f"z{rng.randrange(10_000)}" for _ in range(70)])
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_links(rows)


def chain(n, words=60, step=9):
    """Texts that share most words with the next ones only, never enough for a link."""
    return [(i, " ".join(f"w{j}" for j in range(i * step, i * step + words))) for i in range(n)]


def test_a_chain_of_unlinked_texts_costs_its_length(spark, monkeypatch):
    sent = {}
    plain = jaccard_join._visits

    def counted(shared, placed):
        out = plain(shared, placed)
        sent[placed.count()] = out.count()
        mates = shared.select("node", "key").join(shared.select(F.col("node").alias("mate"), "key"), "key")
        near = mates.select("node", "mate").distinct()
        want = near.join(placed.select(F.col("node").alias("mate"), F.col("block").alias("other")), "mate")
        wide = placed.where("blocks > 1").select("node")
        assert set(map(tuple, out.join(wide, "node").collect())) == set(
            map(tuple, want.select("node", "other").join(wide, "node").distinct().collect()))
        return out
    monkeypatch.setattr(jaccard_join, "_visits", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    for n in (400, 800):
        docs = spark.createDataFrame(chain(n), "doc_id bigint, text string")
        assert {r.n_links for r in jaccard_join.near_duplicates(docs).collect()} == {0}
    (few, rows), (many, more) = sorted(sent.items())
    assert few > 300 and many > 700                  # the texts are one area, or nearly
    assert more / many < 1.25 * rows / few           # blocks double, rows a text stay


def test_pruning_keeps_pairs_at_the_threshold():
    for n in (16, 64, 128):
        m = jaccard_join.least_matches(n, 0.8, 1e-9)
        p = sum(__import__("math").comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(m))
        assert p < 1e-6 and (m > 0 or n <= 16)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    rng = np.random.default_rng(0)
    shuffled = [edges[i] for i in rng.permutation(len(edges))]
    got = dict(tuple(r) for r in components(spark.createDataFrame(shuffled, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 300: 200}
    none = components(spark.createDataFrame([], "u bigint, v bigint"))
    assert none.count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    n = 3000
    edges = [tuple(e) for e in rng.integers(0, n, (1600, 2)).tolist()] + [(5000, 5001 + i) for i in range(2000)]
    label = list(range(8000))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    met = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert len(got) == len(met) and dict(map(tuple, got)) == {x: find(x) for x in met}


BIG = 2 ** 60


def big_docs(spark):
    """Ids beyond the whole numbers of a double, beside null ones."""
    rows = [(BIG + 1, "a"), (BIG + 3, "a"), (BIG + 5, "c"), (None, "b"), (None, "d"), (BIG + 7, "d")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_large_ids_beside_null_ones_stay_whole(spark):
    docs = big_docs(spark)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {(BIG + 1, BIG + 3, 2, False), (BIG + 3, BIG + 3, 2, True), (BIG + 5, BIG + 5, 1, True),
                   (None, None, 1, True), (None, BIG + 7, 2, False), (BIG + 7, BIG + 7, 2, True)}
    left = sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(docs).collect())
    assert left == sorted([(str(BIG + 3), "a"), (str(BIG + 5), "c"), ("None", "b"), (str(BIG + 7), "d")])


def test_repeated_texts_are_found_by_the_filter(spark, monkeypatch):
    """Partial counts of several tasks meet in the index as verified hits."""
    rows = spark.createDataFrame([(i, bytes([i % 3]) * 32) for i in range(60)], "_id bigint, digest binary").repartition(6)
    parts = exact_dedup._partials(rows).collect()
    assert len(parts) > 3 and sum(r.n for r in parts) == 60
    f, hits = CuckooFilter(4), 0
    for r in parts:
        found = f.get(bytes(r.digest))
        hits += found is not None
        if found is None:
            f.insert(bytes(r.digest), [r.n, r.max_id])
        else:
            found[0] += r.n
    assert hits == len(parts) - 3 and sorted(v[0] for v in f.keys.values()) == [20, 20, 20]


def test_few_words_in_a_batch_make_shingles():
    from tidemark.llm.text_hash import shingle_hashes, word_hashes
    for n in range(7):
        for texts in ([" ".join("abcdefg"[:n])], [" ".join("abcdefg"[:n]), None, ""]):
            hashes, offsets = shingle_hashes(*word_hashes(texts))
            assert len(hashes) == offsets[-1] == (0 if n == 0 else max(n - 4, 1))


def test_near_classes_of_a_three_word_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two, three")], "doc_id bigint, text string").coalesce(1)
    assert {r.class_id for r in jaccard_join.near_classes(docs).collect()} == {1}
