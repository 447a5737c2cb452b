"""Quality classifier: a linear hinge-loss model over n-gram indicators that are scaled by naive Bayes log-count ratios.

Indicators: word 1- and 2-grams; 1- to 3-grams of word shapes (which kinds of character follow each other: capitals,
small letters, digits, symbols, marks, others); and words for how much of the text repeats itself (three-word windows
and lines that came before, a word for every tenth reached). All are hashed to 2**18 buckets. A bucket's ratio
log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|) comes from the document counts of both classes over *all* training rows,
added up per task and then per bucket. A row is the vector of its buckets' ratios at length one. The model is fitted by
dual coordinate descent on at most ``fit_rows`` training rows with ``fit_nonzeros`` indicators in all, by hashed id; long
rows that don't fit are passed over, each class has half of the room to itself, and a class that would be left without a
row is an error. Every fifth of them is kept from the fit and sets the sigmoid that turns margins into scores.

Scoring is one pass over the documents with 2 MB of broadcast weights. Empty and null texts have the bare bias as
margin. Repeated labels count once, as 1 if any says so; null labels don't count. Where one class has no training rows,
all scores are the smoothed share of 1.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import hashed_sample, id_crc, numbered, numbered_fields, small_side, stored
from tallysift.llm.decontaminate import _pieces, mixed, words_of

BITS = 18
SIZE = 1 << BITS
SPACES = frozenset(b" \t\n\r\x0b\x0c")
WORDS = bytes(0 if b in SPACES else b + 32 if 65 <= b <= 90 else max(b, 1) for b in range(256))
LINES = bytes(0 if b == 10 else max(b, 1) for b in range(256))
#: Kinds of character: 1 capital, 2 small, 3 digit, 4 mark of a sentence, 5 symbol, 6 beyond ASCII.
SHAPES = bytes(0 if b in SPACES else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57
               else 4 if b in b".,;:?!'\"()-" else 6 if b >= 128 else 5 for b in range(256))
_SALT = [np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in range(1, 9)]


def _before(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the same hash came before in the same document."""
    key = mixed(h, doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(h), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def _tenths(doc: np.ndarray, again: np.ndarray, n: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A (document, hash) for every tenth that the repeated share reaches; the zeroth is any repetition."""
    total = np.maximum(1, np.bincount(doc, minlength=n))
    part = np.bincount(doc[again], minlength=n)
    level = np.where(part > 0, part * 10 // total + 1, 0)
    of = np.repeat(np.arange(n), level)
    k = np.arange(len(of)) - np.repeat(np.cumsum(level) - level, level)
    return of, mixed(np.full(len(of), salt), k.astype(np.uint64))


def indicators(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every indicator, each once, in order."""
    data = b"\n".join(t or b"" for t in texts)
    n, begins = len(texts), np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    starts, _, h = words_of(data.translate(WORDS))
    doc = np.searchsorted(begins, starts, "right") - 1
    kinds = np.frombuffer(data.translate(SHAPES), np.uint8)
    changes = np.ones(len(kinds), bool)
    changes[1:] = kinds[1:] != kinds[:-1]
    shape = words_of(kinds[changes].tobytes())[2]
    line_starts, _, line = words_of(data.translate(LINES))
    line_doc = np.searchsorted(begins, line_starts, "right") - 1
    of, found = [doc, doc], [h * _SALT[0], shape * _SALT[1]]
    pair = doc[1:] == doc[:-1]
    of += [doc[1:][pair]] * 2
    found += [mixed(h[:-1][pair], h[1:][pair]) * _SALT[2], mixed(shape[:-1][pair], shape[1:][pair]) * _SALT[3]]
    three = doc[2:] == doc[:-2]
    triple = mixed(mixed(shape[:-2][three], shape[1:-1][three]), shape[2:][three])
    words3 = mixed(mixed(h[:-2][three], h[1:-1][three]), h[2:][three])
    of.append(doc[2:][three])
    found.append(triple * _SALT[4])
    for where, again, salt in ((doc[2:][three], _before(doc[2:][three], words3), _SALT[5]),
                               (line_doc, _before(line_doc, line), _SALT[6])):
        a, b = _tenths(where, again, n, salt)
        of.append(a)
        found.append(b)
    hashes = np.concatenate(found)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _SALT[7]
    key = np.unique(np.concatenate(of).astype(np.int64) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & SIZE - 1


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) rows to one (bucket, ones, zeros, rows of both) table per task; bucket -1 counts rows."""
    ones, zeros, rows = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64), [0, 0]
    for batch in batches:
        labels, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for piece in _pieces([len(t or b"") for t in texts]):
            doc, bucket = indicators(texts[piece])
            y = labels[piece]
            ones += np.bincount(bucket[y[doc] == 1], minlength=SIZE)
            zeros += np.bincount(bucket[y[doc] == 0], minlength=SIZE)
            rows[0] += int((y == 1).sum())
            rows[1] += int((y == 0).sum())
    at = np.flatnonzero(ones + zeros)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([rows[:1], ones[at]])),
         pa.array(np.concatenate([rows[1:], zeros[at]]))], names=["bucket", "ones", "zeros"])


def indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, label, text) rows to (order, label, buckets)."""
    for batch in batches:
        texts, out = batch.column(2).to_pylist(), []
        for piece in _pieces([len(t or b"") for t in texts]):
            doc, bucket = indicators(texts[piece])
            out += np.split(bucket.astype(np.int32), np.searchsorted(doc, np.arange(1, piece.stop - piece.start)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))],
                                         names=["order", "label", "buckets"])


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 30,
            tolerance: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + cost * hinge losses, by dual coordinate descent.
    ``y``: 1 and -1; ``rows``: buckets whose values are their scales at length one."""
    w, alpha, rng = np.zeros(SIZE + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    values = []
    for b in rows:
        v = scale[b]
        values.append((v / (np.sqrt(v @ v) or 1.0)).astype(np.float32))
    norm = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            b, v = rows[i], values[i]
            slope = y[i] * (w[b] @ v + w[SIZE]) - 1
            bounded = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost else slope
            worst = max(worst, abs(bounded))
            if bounded:
                new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
                step, alpha[i] = (new - alpha[i]) * y[i], new
                w[b] += step * v
                w[SIZE] += step
        if worst < tolerance:
            break
    return w


def sigmoid_of(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits labels to margins, with smoothed targets, by Newton steps."""
    good, bad = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float(np.sum(np.logaddexp(0, z) - t * z))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([np.sum((p - t) * margin), np.sum(p - t)])
        s = p * (1 - p)
        h = np.array([[np.sum(s * margin * margin) + 1e-6, np.sum(s * margin)], [np.sum(s * margin), np.sum(s) + 1e-6]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Weights times ratios, ratios for a row's length, bias and sigmoid."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.ratios, self.products = ratios.astype(np.float32), (ratios * weights[:SIZE]).astype(np.float32)
        self.bias, self.slope, self.shift = float(weights[SIZE]), slope, shift

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(doc, self.ratios[bucket].astype(float) ** 2, minlength=n))
        margin = np.bincount(doc, self.products[bucket].astype(float), minlength=n) / np.where(length > 0, length, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def within(sizes: list[tuple[int, int, int]], nonzeros: int) -> list[int]:
    """Of (order, label, indicators) rows the orders that are fitted on: in that order whatever still fits, a class at a
    time up to its half of ``nonzeros``, then both with what is left. Long rows that don't fit are passed over and don't
    end the sample. An error if a class would be left without any."""
    total: dict[tuple[int, int], int] = {}
    for order, label, size in sizes:
        total[order, label] = total.get((order, label), 0) + size
    picked, left = set(), nonzeros
    for label in (0, 1, None):
        room = left if label is None else nonzeros // 2
        for (order, own), size in sorted(total.items()):
            if order not in picked and label in (own, None) and size <= room:
                picked.add(order)
                room, left = room - size, left - size
        if label is not None and any(own == label for _, own in total) and not any(o in picked for o, own in total if own == label):
            raise ValueError(f"no labelled row of class {label} fits into {nonzeros} indicators: raise fit_nonzeros")
    return sorted(picked)


def fit(docs: DataFrame, labels: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", fit_rows: int = 4000, fit_nonzeros: int = 4_000_000) -> Model:
    """Train on the labelled rows for which ``training`` (a condition on the document id) holds."""
    marks = stored(labels.where(training & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
                   .agg(F.max(label).cast("int").alias("label")).where("label IN (0, 1)"), "marks")
    body = docs.where(training).select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("text"))
    labelled = body.join(small_side(marks), "_id")
    tally = labelled.select("label", "text").mapInArrow(counts_of, "bucket long, ones long, zeros long")
    sums = tally.groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()
    bucket, n_one, n_zero = (sums.column(k).to_numpy() for k in range(3))
    n_ones, n_zeros = int(n_one[bucket < 0].sum()), int(n_zero[bucket < 0].sum())
    flat = np.zeros(SIZE + 1)
    if not n_ones or not n_zeros:
        prior = (n_ones + 1) / (n_ones + n_zeros + 2)
        return Model(np.zeros(SIZE), flat, 0.0, float(np.log(prior / (1 - prior))))
    ones, zeros = np.ones(SIZE), np.ones(SIZE)
    ones[bucket[bucket >= 0]] += n_one[bucket >= 0]
    zeros[bucket[bucket >= 0]] += n_zero[bucket >= 0]
    ratios = np.log(ones / ones.sum()) - np.log(zeros / zeros.sum())
    order = F.xxhash64("_id")
    chosen = stored(hashed_sample(marks, fit_rows, F.col("_id")), "chosen")
    rows = stored(body.join(small_side(chosen), "_id").orderBy(order).limit(fit_rows)
                  .select(order.alias("order"), "label", "text").mapInArrow(
                      indicator_rows, "order long, label int, buckets array<int>"), "sample")
    sizes = [tuple(r) for r in rows.select("order", "label", F.size("buckets")).collect()]
    sample = rows.where(F.col("order").isin(within(sizes, fit_nonzeros))).orderBy("order").select(
        "label", "buckets").toArrow().combine_chunks()
    y = np.where(sample.column("label").to_numpy() == 1, 1.0, -1.0)
    x = [b.values.to_numpy() for b in sample.column("buckets")]
    aside = np.arange(len(x)) % 5 == 4
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    used = [b for b, a in zip(x, aside) if not a]
    if len(set(y[~aside])) < 2:
        return Model(np.zeros(SIZE), flat, 0.0, float(np.log(n_ones / n_zeros)))
    w = descend(used, y[~aside], ratios)
    model = Model(ratios, w, 1.0, 0.0)
    judged = [k for k in range(len(x)) if aside[k]] or list(range(len(x)))
    doc = np.repeat(np.arange(len(judged)), [len(x[k]) for k in judged])
    p = model.scores(doc, np.concatenate([x[k] for k in judged]).astype(np.int64), len(judged))
    model.slope, model.shift = sigmoid_of(np.log(p / (1 - p)), y[judged])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score; of the own columns only ``keep`` (None: all) stay."""
    own = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(*numbered(docs, own), F.col(text).cast("binary").alias("src"))
    schema = T.StructType([*numbered_fields(docs, own), T.StructField("out", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(len(own)).to_pylist(), [np.zeros(0)]
            for piece in _pieces([len(t or b"") for t in texts]):
                out.append(held.value.scores(*indicators(texts[piece]), piece.stop - piece.start))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=schema.names)

    return read.mapInArrow(run, schema).toDF(*own, name)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(id_crc(doc_id), F.lit(4)) == 2
