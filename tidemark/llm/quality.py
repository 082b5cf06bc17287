"""Quality classifier on random-indexing word vectors.

Every token has a fixed sparse random index vector.  A word's vector is the sum of the index
vectors of the tokens around it, over the whole corpus; words share a fixed number of hashed
cells, so the vectors are one matrix of fixed size that tasks sum up in parts.  A document is
the mean of its words' unit vectors and of the vectors of its shape marks (repeated word,
capitals, line end, repeated line and so on).  A two-layer network reads these means; its
probabilities are calibrated by a temperature on rows kept out of its training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, text_or_empty
from .text_hash import mix, runs_of, span_hashes

CELLS = 1 << 14            # hashed vocabulary
DIM = 48                   # of a word vector
NONZERO = 4                # entries of an index vector
REACH = 2                  # neighbours on each side
SHAPES = 8                 # shape marks, see _marks
BLOCK = 1 << 10            # rows of the matrix that travel together
TRAIN_ROWS = 20_000        # labelled rows fitted at most: a bounded sample, smallest hashes first
GROUP_BYTES = 1 << 20

_rng = np.random.default_rng(4711)
_SLOT = _rng.integers(0, DIM, (CELLS, NONZERO))
_SIGN = _rng.choice([-1.0, 1.0], (CELLS, NONZERO))
_MARK = _rng.normal(0, 1, (SHAPES, DIM))

_CLASS = np.zeros(256, dtype=np.int8)          # 0 space, 1 letters, 2 digits, 3 others
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (0 if _i in (9, 10, 11, 12, 13, 32) else 1 if _i >= 128 or _c.isalpha()
                  else 2 if _c.isdigit() else 3)


def tokenise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all tokens, offsets by text, and shape marks (a boolean for each token and mark).

    A token is a run of letters, of digits or of other signs.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    kind = _CLASS[buf]
    if not kind.any():
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros((0, SHAPES), bool)
    change = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate(([0], change))
    ends = np.concatenate((change, [len(buf)]))
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    h = span_hashes(buf, starts, ends)
    offsets = np.searchsorted(starts, bounds)
    upper = (buf >= 65) & (buf <= 90)
    ups = np.concatenate(([0], np.cumsum(upper)))
    n_up, size = ups[ends] - ups[starts], ends - starts
    letters = kind[starts] == 1
    nls = np.concatenate(([0], np.cumsum(buf == 10)))
    line_end = np.concatenate((nls[starts[1:]] > nls[ends[:-1]], [True]))
    first = np.zeros(len(h), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(h)]] = True
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    marks = np.zeros((len(h), SHAPES), dtype=bool)
    marks[:, 0] = same                                   # repeats the token before it
    marks[:, 1] = letters & (n_up > 1) & (n_up * 2 > size)
    marks[:, 2] = letters & (n_up == 1)
    marks[:, 3] = kind[starts] == 2
    marks[:, 4] = kind[starts] == 3
    marks[:, 5] = (kind[starts] == 3) & (size > 1)
    marks[:, 6] = line_end
    marks[:, 7] = _repeated_lines(buf, bounds, starts, offsets)
    return (h % np.uint64(CELLS)).astype(np.int64), offsets, marks


def _repeated_lines(buf: np.ndarray, bounds: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the tokens of lines that occurred earlier in the same text."""
    s, e = runs_of(buf != 10)
    if not len(s):
        return np.zeros(len(starts), dtype=bool)
    doc = np.searchsorted(bounds, s, side="right").astype(np.uint64)
    key = mix(span_hashes(buf, s, e) + doc * np.uint64(0x9E3779B97F4A7C15))
    _, where = np.unique(key, return_index=True)
    again = np.ones(len(s), dtype=bool)
    again[where] = False
    line = np.clip(np.searchsorted(s, starts, side="right") - 1, 0, len(s) - 1)
    return again[line]


def grouped(texts: list[bytes]):
    """Consecutive slices of ``texts`` of about GROUP_BYTES, at least one text each."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_BYTES):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def add_contexts(matrix: np.ndarray, cells: np.ndarray, offsets: np.ndarray) -> None:
    """Add the index vectors of every token's neighbours in the same text to its vector."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flat = matrix.reshape(-1)
    for d in range(1, REACH + 1):
        if len(cells) <= d:
            continue
        inside = np.flatnonzero(doc[:-d] == doc[d:])
        left, right = cells[inside], cells[inside + d]
        for j in range(NONZERO):
            for of, near in ((left, right), (right, left)):
                at, inv = np.unique(of * DIM + _SLOT[near, j], return_inverse=True)
                flat[at] += np.bincount(inv, weights=_SIGN[near, j])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word matrix over all texts, unit rows (CELLS x DIM: a few MB whatever the corpus)."""
    ship(docs.sparkSession)

    def count(batches):
        matrix = np.zeros((CELLS, DIM))
        seen = False
        for b in batches:
            for group in grouped(b.column(0).cast(pa.binary()).to_pylist()):
                seen = True
                cells, offsets, _ = tokenise(group)
                add_contexts(matrix, cells, offsets)
        if seen:
            blocks = matrix.astype(np.float32).reshape(-1, BLOCK * DIM)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()),
                                              pa.array([x.tobytes() for x in blocks], pa.binary())],
                                             names=["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * DIM)
        for x in pdf["part"]:
            total += np.frombuffer(x, dtype=np.float32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    parts = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "block int, part binary")
    # Two rounds, so that no task adds up the parts of every task of the scan.
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(16)))
    once = parts.groupBy("block", "salt").applyInPandas(lambda p: add(p[["block", "part"]]), "block int, part binary")
    rows = once.groupBy("block").applyInPandas(add, "block int, part binary").collect()   # CELLS x DIM floats
    matrix = np.zeros((CELLS // BLOCK, BLOCK * DIM), dtype=np.float32)
    for r in rows:
        matrix[r["block"]] = np.frombuffer(r["part"], dtype=np.float32)
    matrix = matrix.reshape(CELLS, DIM)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1)


def pooled(texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """One row for each text: mean word vector, mean of mark vectors, shares of the marks."""
    out = []
    for group in grouped(texts):
        cells, offsets, marks = tokenise(group)
        n = np.diff(offsets)
        size = np.maximum(n, 1)[:, None]
        words = np.zeros((len(n), matrix.shape[1]))
        shares = np.zeros((len(n), SHAPES))
        filled = n > 0
        if filled.any():
            begin = offsets[:-1][filled]
            words[filled] = np.add.reduceat(matrix[cells], begin, axis=0)
            shares[filled] = np.add.reduceat(marks.astype(np.float32), begin, axis=0)
        shares = shares / size
        out.append(np.hstack([words / size, shares @ _MARK[:, :DIM] / 4, shares, np.log1p(n)[:, None] / 10]))
    width = matrix.shape[1] + DIM + SHAPES + 1
    return np.vstack(out).astype(np.float32) if out else np.zeros((0, width), np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5) -> QualityModel:
    """Adam on log loss; every fifth row is kept out to calibrate the temperature.

    With rows of one class only, or none, the model returns that class's smoothed share.
    """
    width = x.shape[1]
    y = y.astype(np.float64)
    x = x.astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1),
                            float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    tx, ty = x[~held], y[~held]
    mean, scale = tx.mean(0), tx.std(0) + 1e-2
    tx = (tx - mean) / scale
    p = [rng.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden),
         np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step, batch = 0, max(32, min(256, len(ty) // 8))
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // batch)):
            bx, by = tx[at], ty[at]
            a = bx @ p[0] + p[1]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - by) / len(by)
            dh = np.outer(d, p[2]) * (a > 0)
            grads = [bx.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.004 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    model = QualityModel(mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if held.any():
        z = model.logit(x[held])
        model.temperature = min((round(float(t), 3) for t in np.geomspace(0.25, 8, 41)),
                                key=lambda t: _log_loss(z / t, y[held]))
    return model


def is_held_out(id_col: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text, modulo 5, is 0 (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score of every whole text: 0 to 1, higher where label 1 is likelier.

    Learns from at most ``train_rows`` labelled rows that are not held out, those of smallest
    id hash; word vectors come from all texts.  Only the text enters a score.  Returns one row
    per input row: the id column, ``held_out`` and ``score``.  Null and empty texts get the
    score of an empty text; equal texts get equal scores; labels that are null or name no
    document are ignored; without usable labels every score is 0.5.
    """
    vectors = word_vectors(docs, text_col)
    model = _fit_from(docs, labels, vectors, id_col, text_col, label_col, train_rows)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = pooled(b.column("_text").cast(pa.binary()).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_held"),
                                              pa.array(model.score(x), pa.float64())],
                                             names=[id_col, "held_out", "score"])

    src = docs.select(F.col(id_col).alias("_id"), is_held_out(id_col).alias("_held"),
                      text_or_empty(text_col).alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double")


def _fit_from(docs, labels, vectors, id_col, text_col, label_col, train_rows) -> QualityModel:
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(train_rows))      # a bounded sample, fixed by the ids
    text = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = text.join(F.broadcast(cut(known)), "_id")                    # train_rows rows of two numbers

    def pool(batches):
        for b in batches:
            x = pooled(b.column("_text").cast(pa.binary()).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"),
                                              pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "y", "x"])

    got = (rows.select("_id", "_y", "_text").mapInArrow(pool, f"id {rows.schema['_id'].dataType.simpleString()}, y int, x binary")
           .groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x"))
           .orderBy(F.xxhash64("id"), "id").collect())
    width = vectors.shape[1] + DIM + SHAPES + 1
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in got]).reshape(-1, width)
    return fit(x, np.array([r["y"] for r in got], dtype=np.int64))


def keep_good(docs: DataFrame, labels: DataFrame, cut_at: float = 0.3, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut_at``, all columns unchanged."""
    vectors = word_vectors(docs, text_col)
    model = _fit_from(docs, labels, vectors, id_col, text_col, label_col, train_rows)

    def run(batches):
        for b in batches:
            texts = b.column(text_col).fill_null("").cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(model.score(pooled(texts, vectors)) >= cut_at, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
