"""Small tables with every awkward case, shared by the operator tests."""

import random
import re

WORDS = ["alpha", "bravo", "Charlie", "delta,", "echo.", "foxtrot", "été", "straße", "golf!", "hotel", "india", "x1"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def messy_docs(spark, repeat=True):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "changed ")
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "hi"), (5, "hi"), (6, base), (7, near), (8, base),
            (9, sentence(rng, 60_000)), (10, "a" * 50_000), (11, "one two three four"), (12, "One two, three four"),
            (13, "\x00 odd \u2028 signs \U0001f600 e\u0301"), (14, "<|endoftext|> in text"), (None, "no id here at all"),
            (None, None)]
    rows += [(100 + i, sentence(rng, 40)) for i in range(30)]
    if repeat:
        rows += [(6, base), (4, "hi")]
    extra = [(i, t, "en", "src", None if t is None else len(t), 7, "x", 1, "y", 2) for i, t in rows]
    return spark.createDataFrame(
        extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
               "id bigint, rep string, block int, digest string, label int")


def empty_like(df):
    return df.where("1 = 0")


def words_of(text):
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text, n=5):
    w = words_of(text)
    if not w:
        return set()
    return set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)}
