"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the texts between block-level tags, in page order.  A block
is described by its tag path (names, classes, ids and roles of the open elements), its hashed
words and a few counts.  A bidirectional LSTM in numpy reads the whole sequence, so each
block is judged in the context of the document, and labels every block as main text or not.

It is trained on a bounded sample of the pages.  Their blocks are labelled by the elements
they lie in, and varied: containers renamed, and navigation, notices, adverts, forms, comments
and the like set in at random places, with words drawn from the same pages, so the labels are
learnt from structure and context.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .text_hash import word_hashes

# Elements by the way they shape blocks, and names that mark what a block is.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav
noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea xmp".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("html body article aside section div main table td th ul ol dl select button form nav".split())
BOILER = tuple("""nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsor sponsored
cookie notice consent popup modal form subscribe newsletter signup login search comment comments reply replies related
recommended share social breadcrumb breadcrumbs pagination tags widget toolbar skip copyright legal hidden button
select option label noscript template iframe title masthead alert dialog topbar navbar""".split())
CONTENT = tuple("article main content post entry story".split())
INSIDE = tuple("p h2 h3 li blockquote pre td dd figcaption".split())

PATH_DIM, WORD_DIM, COUNTS = 192, 24, 6
EMBED, HIDDEN = 32, 20
SAMPLE_PAGES, SAMPLE_BYTES = 240, 200_000    # pages learnt from at most, and bytes of one of them
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)"""
                  r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int            # characters inside links


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """Names of an open element: its tag, and the parts of its class, id and role."""
    if not attrs:
        return (tag,)
    out = [tag]
    for key, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if key.lower() == "hidden" or (key.lower() == "aria-hidden" and value == "true") or \
                (key.lower() == "style" and "display:none" in value.replace(" ", "")):
            out.append("hidden")
        elif key.lower() in ("class", "id", "role"):
            out.extend(_NAME.findall(value))
    return tuple(out)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, character references decoded, white space collapsed."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(n for _, names in stack for n in names), text, linked))
            parts.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            flush()
            return out
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:                                  # comment, doctype
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag in BLOCK_TAGS:
                flush()
            if depth >= 0 and (tag in BLOCK_TAGS or not any(t in BLOCK_TAGS for t, _ in stack[depth + 1:])):
                del stack[depth:]
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            ends = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends or (stack[i][0] == "p" and not ends):
                    del stack[i:]
                    break
                if stack[i][0] in BOUNDS:
                    break
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                flush()
                return out
            at = page.find(">", end.start())
            at = len(page) if at < 0 else at + 1
        elif tag not in VOID_TAGS and not (m[3] or "").endswith("/"):
            stack.append((tag, _names(tag, m[3] or "")))


def _slot(name: str, depth_last: bool) -> int:
    return zlib.crc32((("=" if depth_last else "") + name).encode()) % PATH_DIM


_slots: dict[tuple[str, ...], np.ndarray] = {}


def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    got = _slots.get(path)
    if got is None:
        if len(_slots) > 20_000:
            _slots.clear()
        at = {_slot(n, False) for n in path}
        if path:
            at.add(_slot(path[-1], True))
        got = _slots[path] = np.array(sorted(at), dtype=np.int64)
    return got


def features(blocks: list[Block]) -> np.ndarray:
    """One row for each block: tag path, hashed words, counts."""
    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + COUNTS), dtype=np.float32)
    if not blocks:
        return x
    slots = [_path_slots(b.path) for b in blocks]
    x[np.repeat(np.arange(len(blocks)), [len(s) for s in slots]), np.concatenate(slots)] = 1
    words, off = word_hashes([b.text for b in blocks])
    n = np.diff(off)
    row = np.repeat(np.arange(len(blocks)), n)
    bag = np.bincount(row * WORD_DIM + (words % np.uint64(WORD_DIM)).astype(np.int64),
                      minlength=len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM:PATH_DIM + WORD_DIM] = bag / np.maximum(n, 1)[:, None]
    size = np.array([len(b.text) for b in blocks])
    stops = np.array([sum(b.text.count(c) for c in ".!?,;") for b in blocks])
    x[:, -COUNTS:] = np.stack([np.log1p(size) / 8, np.log1p(n) / 6, stops / np.maximum(n, 1),
                               np.array([b.linked for b in blocks]) / np.maximum(size, 1),
                               np.array([len(b.path) for b in blocks]) / 16, n > 8], axis=1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Embedding, one LSTM in each direction, one logit for each block."""

    def __init__(self, rng: np.random.Generator):
        d = PATH_DIM + WORD_DIM + COUNTS
        def w(a: int, b: int) -> np.ndarray:
            return rng.normal(0, (a + b) ** -0.5, (a, b))
        self.p = {"We": w(d, EMBED), "be": np.zeros(EMBED), "wo": w(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(())}
        for s in "fb":
            self.p |= {f"W{s}": w(EMBED, 4 * HIDDEN), f"U{s}": w(HIDDEN, 4 * HIDDEN), f"b{s}": np.zeros(4 * HIDDEN)}
            self.p[f"b{s}"][HIDDEN:2 * HIDDEN] = 1.0                       # forget gates start open

    def _lstm(self, e: np.ndarray, mask: np.ndarray, s: str, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction; ``e`` is already in reading order."""
        steps, batch = mask.shape
        pre = e @ self.p[f"W{s}"] + self.p[f"b{s}"]
        u = self.p[f"U{s}"]
        h = np.zeros((batch, HIDDEN), dtype=pre.dtype)
        c = np.zeros((batch, HIDDEN), dtype=pre.dtype)
        out = np.zeros((steps, batch, HIDDEN), dtype=pre.dtype)
        for t in range(steps):
            z = pre[t] + h @ u
            gate = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, g, th))
            m = mask[t][:, None]
            h, c = np.where(m, o * th, 0), np.where(m, new, 0)
            out[t] = h
        return out

    @staticmethod
    def _flip(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each sequence reversed within its own length."""
        t = np.arange(len(x))[:, None]
        back = np.where(t < sizes[None, :], sizes[None, :] - 1 - t, t)
        return x[back, np.arange(x.shape[1])[None, :]]

    def _run(self, x: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        mask = np.arange(len(x))[:, None] < sizes[None, :]
        e = np.tanh(x @ self.p["We"] + self.p["be"])
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._lstm(e, mask, "f", kf)
        hb = self._flip(self._lstm(self._flip(e, sizes), mask, "b", kb), sizes)
        if keep is not None:
            keep |= {"mask": mask, "e": e, "kf": kf, "kb": kb, "hf": hf, "hb": hb}
        return hf @ self.p["wo"][:HIDDEN] + hb @ self.p["wo"][HIDDEN:] + self.p["bo"]

    def _back(self, dh: np.ndarray, e: np.ndarray, mask: np.ndarray, kept: list, s: str, grads: dict) -> np.ndarray:
        u, w = self.p[f"U{s}"], self.p[f"W{s}"]
        dz_all = np.zeros((*mask.shape, 4 * HIDDEN))
        carry_h = np.zeros(dh.shape[1:])
        carry_c = np.zeros(dh.shape[1:])
        du = np.zeros_like(u)
        for t in range(len(mask) - 1, -1, -1):
            h, c, i, f, o, g, th = kept[t]
            m = mask[t][:, None]
            d = np.where(m, dh[t] + carry_h, 0)
            dc = np.where(m, carry_c + d * o * (1 - th ** 2), 0)
            dz = np.hstack([dc * g * i * (1 - i), dc * c * f * (1 - f), d * th * o * (1 - o), dc * i * (1 - g ** 2)])
            dz_all[t] = dz
            du += h.T @ dz
            carry_h, carry_c = dz @ u.T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"U{s}"], grads[f"b{s}"] = du, flat.sum(0)
        grads[f"W{s}"] = e.reshape(-1, EMBED).T @ flat
        return dz_all @ w.T

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean log loss over all blocks of a padded batch."""
        k: dict = {}
        z = self._run(x, sizes, k)
        n = k["mask"].sum()
        dz = np.where(k["mask"], _sigmoid(z) - y, 0) / n
        loss = float(np.where(k["mask"], np.logaddexp(0, z) - y * z, 0).sum() / n)
        grads = {"bo": dz.sum(), "wo": np.concatenate([np.einsum("tb,tbh->h", dz, k["hf"]),
                                                       np.einsum("tb,tbh->h", dz, k["hb"])])}
        de = self._back(dz[:, :, None] * self.p["wo"][:HIDDEN], k["e"], k["mask"], k["kf"], "f", grads)
        db = self._flip(dz[:, :, None] * self.p["wo"][HIDDEN:], sizes)
        de = de + self._flip(self._back(db, self._flip(k["e"], sizes), k["mask"], k["kb"], "b", grads), sizes)
        da = de * (1 - k["e"] ** 2)
        grads["We"] = x.reshape(-1, x.shape[2]).T @ da.reshape(-1, EMBED)
        grads["be"] = da.sum((0, 1))
        return grads, loss

    def probabilities(self, pages: list[np.ndarray], budget: int = 20_000) -> list[np.ndarray]:
        """Probability of main text for every block of every page (rows of ``features``)."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):                            # batches of pages of like length
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= budget:
                end += 1
            which = order[at:end]
            x, sizes = pad([pages[i] for i in which])
            z = self._run(x, sizes)
            for b, i in enumerate(which):
                out[i] = _sigmoid(z[:sizes[b], b])
            at = end
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((sizes.max(), len(pages), pages[0].shape[1]), dtype=np.float32)
    for b, p in enumerate(pages):
        x[:len(p), b] = p
    return x, sizes


def label_by_structure(block: Block) -> bool | None:
    """True or false where the elements say so plainly, None elsewhere."""
    names = set(block.path)
    if names & set(BOILER):
        return False
    return True if names & set(CONTENT) else None


def vary(blocks: list[Block], labels: list[bool], texts: list[str], rng: np.random.Generator):
    """A varied copy of a labelled page: another container, and boilerplate set in."""
    def text(long: bool) -> str:
        words = texts[int(rng.integers(len(texts)))].split() or ["x"]
        n = int(rng.integers(8, 60)) if long else int(rng.integers(1, 9))
        at = int(rng.integers(max(1, len(words) - n + 1)))
        return " ".join(words[at:at + n])

    kind = ((), ("div", str(rng.choice(CONTENT))), (str(rng.choice(("article", "main"))),),
            ("section", str(rng.choice(CONTENT)), "body"))[int(rng.integers(4))]
    out, marks = [], []
    for b, y in zip(blocks, labels):
        path = b.path
        if y and "article" in path:
            at = path.index("article")
            path = path[:at] + kind + path[at + 1:]
        # Lengths vary on both sides, so that a short paragraph is not taken for a menu entry.
        words = text(not y) if rng.random() < 0.25 else b.text
        out.append(Block(path, words, len(words) if b.linked else 0))
        marks.append(y)
    for _ in range(int(rng.integers(0, 9))):
        name = str(rng.choice(BOILER))
        near = int(rng.integers(len(out) + 1))
        inside = near < len(out) and marks[near] and rng.random() < 0.6
        base = ("html", "body") + (kind if inside else ())
        form = int(rng.integers(4))
        path = base + ((name,) if form == 0 else ("div", name) if form == 1
                       else ("section", name, str(rng.choice(("box", "area", "list", "wrap")))) if form == 2
                       else ("ul", name))
        for _ in range(int(rng.integers(1, 5))):
            tail = (str(rng.choice(("p", "li", "a", "span", "h3", "div", "h1", "article"))),) if rng.random() < 0.8 else ()
            t = text(rng.random() < 0.5)
            out.insert(near, Block(path + tail, t, len(t) if "a" in tail else 0))
            marks.insert(near, False)
    for i in range(len(out)):                             # content comes in many leaf elements
        if marks[i] and rng.random() < 0.15:
            out[i] = Block(out[i].path[:-1] + (str(rng.choice(INSIDE)),), out[i].text, out[i].linked)
    return out, marks


def train(pages: list[str], seed: int = 11, epochs: int = 9, copies: int = 3) -> BlockLabeller:
    """Fit a labeller on sample pages (and on a built-in page, so that it works without any)."""
    rng = np.random.default_rng(seed)
    plain = ("<html><head><title>a page</title></head><body><nav><ul><li><a>home</a></li><li><a>about</a></li></ul>"
             "</nav><article><h1>A heading of a page</h1><p>Some words of a first part, and more of it.</p><p>A second "
             "part of the same text.</p></article><footer>All of the rest.</footer></body></html>")
    parsed = [blocks_of(p) for p in [*pages, *[plain] * 8]]
    texts = [b.text for bs in parsed for b in bs] or ["x"]
    data = []
    for bs in parsed:
        marks = [label_by_structure(b) for b in bs]
        known = [(b, m) for b, m in zip(bs, marks) if m is not None]
        if not known:
            continue
        bs, marks = [b for b, _ in known], [m for _, m in known]
        for v in range(copies + 1):
            x, y = (bs, marks) if v == 0 else vary(bs, marks, texts, rng)
            lo = int(rng.integers(max(1, len(x) - 63)))   # stretches of 64 blocks are learnt from
            data.append((features(x[lo:lo + 64]), np.array(y[lo:lo + 64], dtype=np.float64)))
    model = BlockLabeller(rng)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    rounds = max(epochs, -(-epochs * 600 // len(data)))   # few pages are seen more often
    for _ in range(min(rounds, 40)):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][0]) // 12 for i in order], kind="stable")]
        batches = [order[i:i + 24] for i in range(0, len(order), 24)]
        for b in rng.permutation(len(batches)):
            x, sizes = pad([data[i][0] for i in batches[b]])
            y = np.zeros(x.shape[:2])
            for j, i in enumerate(batches[b]):
                y[:sizes[j], j] = data[i][1]
            grads, _ = model.gradients(x, sizes, y)
            norm = np.sqrt(sum(float(np.sum(g * g)) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                model.p[k] = model.p[k] - 0.008 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
    model.p = {k: np.asarray(p, dtype=np.float32) for k, p in model.p.items()}
    return model


def sample_pages(pages: DataFrame, id_col: str, html_col: str, n: int = SAMPLE_PAGES) -> list[str]:
    """At most ``n`` pages of at most SAMPLE_BYTES: those of smallest id hash, one of each id.

    Hashes are chosen first, so a task sends the driver ``n`` hashes at most, and pages only of
    the ids chosen: what reaches the driver is at most ``n`` pages however many tasks there are.
    """
    fit = (pages.where(F.col(html_col).isNotNull() & (F.octet_length(html_col) <= SAMPLE_BYTES))
           .select(F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).alias("html")))
    few = [r["h"] for r in fit.select("h").distinct().orderBy("h").limit(n).collect()]
    if not few:
        return []
    chosen = fit.where(F.col("h").isin(few)).groupBy("h").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(chosen.collect(), key=lambda r: r["h"])]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 threshold: float = 0.5) -> DataFrame:
    """Main text of every page, from its whole html.

    Returns one row per input row: the id and url columns, ``text`` (main blocks joined by one
    space), ``n_blocks`` and ``n_main``.  Null or empty html gives an empty text; repeated rows
    and null ids or urls are kept; an empty table gives an empty result; other columns are
    never read.
    """
    ship(pages.sparkSession)
    model = train(sample_pages(pages, id_col, html_col))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, urls, sources = b.column("_id"), b.column("_url"), b.column("_html").to_pylist()
            at = 0
            while at < len(sources):                      # a few MB of pages at a time
                size, end = 0, at
                while end < len(sources) and (end == at or size + len(sources[end] or "") <= 4 << 20):
                    size += len(sources[end] or "")
                    end += 1
                cut_up = [blocks_of(s) for s in sources[at:end]]
                flat = features([x for bs in cut_up for x in bs])
                edges = np.cumsum([0] + [len(bs) for bs in cut_up])
                p = model.probabilities([flat[x:y] for x, y in zip(edges[:-1], edges[1:])])
                main = [[x.text for x, q in zip(bs, ps) if q >= threshold] for bs, ps in zip(cut_up, p)]
                yield pa.RecordBatch.from_arrays(
                    [ids[at:end], urls[at:end], pa.array([" ".join(x) for x in main], pa.string()),
                     pa.array([len(x) for x in cut_up], pa.int32()), pa.array([len(x) for x in main], pa.int32())],
                    names=[id_col, url_col, "text", "n_blocks", "n_main"])
                at = end

    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return src.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_blocks int, n_main int")
