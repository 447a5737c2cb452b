"""Main text of pages: a bidirectional LSTM in numpy labels every leaf block.

A page is the sequence of its leaf blocks. A block enters as the mean of its tag-path vectors (tags and class, id and
role words of all open elements, hashed), the mean of its hashed words' vectors and four figures; one LSTM reads the
page forwards, one backwards, so each block is judged with the whole page in view. Blocks judged as main text are
joined by a space.

The model is trained here, by back-propagation through the pages and Adam, on made-up pages with known labels
(``page_blocks.invented``) and on ``fit_pages`` real ones, those with the least hash, labelled by the elements they
stand in (an article or main element against navigation, asides, footers, forms, and against comments, adverts and
notices inside it). The sample has that bound and pages
of at most ``fit_chars``; it is all the driver holds. All pages are labelled, whole, in tasks that get the trained
weights (about 250 kB). Null and empty pages give an empty text.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import hashed_sample, numbered, numbered_fields
from tallysift.llm.page_blocks import TAG_BUCKETS, WORD_BUCKETS, Features, blocks_of, invented

TAG_SIZE, WORD_SIZE, HIDDEN, FIGURES = 16, 8, 16, 4
INPUTS = TAG_SIZE + WORD_SIZE + FIGURES
#: Pages labelled at once.
GROUP = 256
NOT_MAIN = {"nav", "aside", "footer", "form", "header", "datalist", "option"}


#: Class, id and role words of containers that are not main text inside an article or main element.
NOT_MAIN_INSIDE = {f".{w}" for w in (
    "comment comments commentlist replies discussion ad ads advert advertisement banner sponsored promo cookie notice alert "
    "notification consent social share newsletter subscribe popup modal related sidebar widget").split()}


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"tag": rng.normal(0, 0.3, (TAG_BUCKETS, TAG_SIZE)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)),
         "out": rng.normal(0, 0.1, (2 * HIDDEN,)), "bias": np.zeros(1)}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, INPUTS ** -0.5, (INPUTS, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return w


def _mean(table: np.ndarray, bucket: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean vectors per block and one over each block's count."""
    scale = 1 / np.maximum(1, np.bincount(of, minlength=n))
    total = np.zeros((n, table.shape[1]))
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        total[of[first]] = np.add.reduceat(table[bucket], first, axis=0)
    return total * scale[:, None], scale


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(w: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: (steps, pages, inputs). Past a page's end the state stands still."""
    steps, pages, _ = x.shape
    h, c, out, tape = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros((steps, pages, HIDDEN)), []
    z = x @ w[f"x{d}"] + w[f"c{d}"]
    for t in range(steps):
        g = z[t] + h @ w[f"h{d}"]
        s, cand = _sigmoid(g[:, :3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN:])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
        m = mask[t][:, None]
        new = f * c + i * cand
        tan = np.tanh(new)
        if keep:
            tape.append((h, c, i, f, o, cand, tan, m))
        c = np.where(m, new, c)
        h = np.where(m, o * tan, h)
        out[t] = h
    return out, tape


def _lstm_back(w: dict, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    steps, pages, _ = x.shape
    dh, dc, dz = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros((steps, pages, 4 * HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, cand, tan, m = tape[t]
        dh = dh + dout[t]
        own = dh * m
        dnew = (own * o * (1 - tan * tan) + dc) * m
        dz[t] = np.concatenate([dnew * cand * i * (1 - i), dnew * c * f * (1 - f), own * tan * o * (1 - o),
                                dnew * i * (1 - cand * cand)], axis=1)
        grad[f"h{d}"] += h.T @ dz[t]
        dh = dh * ~m + dz[t] @ w[f"h{d}"].T
        dc = dc * ~m + dnew * f
    grad[f"x{d}"] += np.einsum("tpi,tpg->ig", x, dz)
    grad[f"c{d}"] += dz.sum((0, 1))
    return dz @ w[f"x{d}"].T


class Pass:
    """One forward pass over a group of pages; ``back`` gives the gradients."""

    def __init__(self, w: dict, f: Features, keep: bool = False):
        self.w, self.f, n = w, f, int(f.sizes.sum())
        tags, self.tag_scale = _mean(w["tag"], f.tag, f.tag_of, n)
        words, self.word_scale = _mean(w["word"], f.word, f.word_of, n)
        flat = np.concatenate([tags, words, f.figures], axis=1)
        page = np.repeat(np.arange(len(f.sizes)), f.sizes)
        step = np.arange(n) - np.repeat(np.cumsum(f.sizes) - f.sizes, f.sizes)
        steps = int(f.sizes.max()) if n else 0
        self.at = (step, page)
        self.turned = (np.repeat(f.sizes, f.sizes) - 1 - step, page)
        mask = np.arange(steps)[:, None] < f.sizes
        self.x = [np.zeros((steps, len(f.sizes), INPUTS)) for _ in range(2)]
        self.x[0][self.at], self.x[1][self.turned] = flat, flat
        (a, self.ta), (b, self.tb) = (_lstm(w, d, x, mask, keep) for d, x in zip("fb", self.x))
        self.state = np.concatenate([a[self.at], b[self.turned]], axis=1)
        self.p = _sigmoid(self.state @ w["out"] + w["bias"])

    def back(self, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, f, grad = self.w, self.f, {k: np.zeros_like(v) for k, v in self.w.items()}
        d = (self.p - labels) / len(labels)
        grad["out"], grad["bias"] = self.state.T @ d, d.sum(keepdims=True)
        dstate = d[:, None] * w["out"]
        dflat = np.zeros((len(d), INPUTS))
        for k, (name, where, tape) in enumerate((("f", self.at, self.ta), ("b", self.turned, self.tb))):
            dout = np.zeros((*self.x[k].shape[:2], HIDDEN))
            dout[where] = dstate[:, k * HIDDEN:(k + 1) * HIDDEN]
            dflat += _lstm_back(w, name, self.x[k], tape, dout, grad)[where]
        np.add.at(grad["tag"], f.tag, (dflat[:, :TAG_SIZE] * self.tag_scale[:, None])[f.tag_of])
        np.add.at(grad["word"], f.word, (dflat[:, TAG_SIZE:TAG_SIZE + WORD_SIZE] * self.word_scale[:, None])[f.word_of])
        return grad


def train(pages: list, epochs: int = 6, rate: float = 0.01, group: int = 16, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights from (blocks, labels) pages."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    first, second, step = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2)), None, 0
    m, v = first
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
    groups = [order[k:k + group] for k in range(0, len(order), group)]
    ready = [(Features([pages[k][0] for k in g]), np.concatenate([pages[k][1] for k in g])) for g in groups]
    for epoch in range(epochs):
        for k in rng.permutation(len(ready)):
            f, y = ready[k]
            grad, step = Pass(w, f, keep=True).back(y), step + 1
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                w[name] = w[name] - rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


def by_elements(page: list) -> np.ndarray | None:
    """Labels of a page that says itself which block is what; None for others."""
    def main(path: list[str]) -> bool:
        at = next((k for k, t in enumerate(path) if t in ("article", "main")), None)
        if at is None or not NOT_MAIN.isdisjoint(path):
            return False
        inner = itertools.dropwhile(lambda t: t.startswith("."), path[at + 1:])
        return NOT_MAIN_INSIDE.isdisjoint(inner)

    labels = np.array([float(main(path)) for _, path, _ in page])
    return labels if labels.any() else None


def fit(pages: DataFrame, html: str = "html", fit_pages: int = 192, fit_chars: int = 200_000, made_up: int = 300) -> dict:
    """Train on made-up pages and a bounded sample of real ones."""
    rows = hashed_sample(pages.where(F.length(html) <= fit_chars).select(html), fit_pages, F.col(html)).collect()
    known = [(b, y) for b in (blocks_of(r[0]) for r in rows) if b and (y := by_elements(b)) is not None]
    return train(known + invented(made_up, seed=5))


def main_texts(w: dict, pages: list[str | None]) -> list[str]:
    """The main text of each page; pages of like length are labelled together."""
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    for at in range(0, len(order), GROUP):
        group = order[at:at + GROUP]
        found = Pass(w, Features([parsed[k] for k in group])).p >= 0.5
        ends = np.cumsum([len(parsed[k]) for k in group])
        for k, end in zip(group, ends):
            marks = found[end - len(parsed[k]):end]
            out[k] = " ".join(t for (t, _, _), y in zip(parsed[k], marks) if y)
    return out


def extract(pages: DataFrame, weights: dict | None = None, html: str = "html", name: str = "main_text",
            keep: list[str] | None = None) -> DataFrame:
    """Add the main text; of the own columns only ``keep`` (None: all) stay."""
    own = pages.columns if keep is None else keep
    held = pages.sparkSession.sparkContext.broadcast(weights or fit(pages, html))
    read = pages.select(*numbered(pages, own), F.col(html).alias("src"))
    schema = T.StructType([*numbered_fields(pages, own), T.StructField("out", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4 * GROUP):
                part = batch.slice(at, 4 * GROUP)
                texts = main_texts(held.value, part.column(len(own)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return read.mapInArrow(run, schema).toDF(*own, name)
