"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has a bit where over half of its word shingles' XXH64 hashes have it. The 64 bits are cut into a
ring of six segments. If two fingerprints differ in at most two bits, some chain of consecutive segments has, for
every prefix of l segments, at most floor(l * 2 / 6) differing bits in all: 0, 0, 1, 1, 1, 2. So two neighbouring
segments agree and of the next three at least two: fingerprints are bucketed by those four segments (15 masks, 42 bits
or more), and only pairs of a bucket with a viable chain get the full Hamming check. Distinct fingerprints are what is
bucketed, so copies cost nothing; a bucket can hold 2**22 of them at most, since 42 bits are fixed, and hands on a
spanning set of links, never all pairs.

Texts without words have fingerprint zero and are linked like any other. Null ids take part but never name a
component unless all its ids are null. Repeated rows keep their count.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import free_name, numbered, numbered_fields, own_columns, stored
from tallysift.llm.components import roots

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
BITS = 2
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
BLOCK = 1 << 16


def _mask(segments) -> int:
    return sum(((1 << n) - 1) << at for at, n in (SEGMENTS[s] for s in segments))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: For each chain start: its two first segments and two of the next three; equal sets once.
KEYS = sorted({_mask((s, (s + 1) % 6, *((s + 2 + k) % 6 for k in range(3) if k != skip)))
               for s in range(6) for skip in range(3)})
SEGMENT_MASKS = [np.uint64(_mask([s])) for s in range(6)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text; zero without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[-n:] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[k:k + BLOCK], ends[k:k + BLOCK])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None,
                     shingle: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long; of the own columns only ``keep`` (None: all) stay."""
    own = docs.columns if keep is None else keep
    read = docs.select(*numbered(docs, own), F.col(text).cast("binary").alias("src"))
    schema = T.StructType([*numbered_fields(docs, own), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(len(own))), np.uint64, len(batch))
            columns = [batch.column(i) for i in range(len(own))] + [pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return read.mapInArrow(run, schema).toDF(*own, name)


def viable(x: np.ndarray) -> np.ndarray:
    """Whether differences ``x`` (xor of two fingerprints) have a chain within the budgets from some start."""
    d = [np.bitwise_count(x & m) for m in SEGMENT_MASKS]
    ok = np.zeros(x.shape, bool)
    for start in range(6):
        run, good = np.zeros(x.shape, np.int64), np.ones(x.shape, bool)
        for length in range(1, 7):
            run += d[(start + length - 1) % 6]
            good &= run <= length * BITS // 6
        ok |= good
    return ok


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    ok = viable(x)
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def small_buckets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many buckets of one size, a bucket per row."""
    m, n = rows.shape
    label = np.tile(np.arange(n), (m, 1))
    pairs = [(i, j, linked(rows[:, i], rows[:, j])) for i, j in combinations(range(n), 2)]
    while True:
        before = label.copy()
        for i, j, ok in pairs:
            least = np.minimum(label[:, i], label[:, j])
            label[:, i] = np.where(ok, least, label[:, i])
            label[:, j] = np.where(ok, least, label[:, j])
        if (before == label).all():
            break
    away = label != np.arange(n)
    return rows[away], np.take_along_axis(rows, label, 1)[away]


def large_bucket(fps: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one bucket of any size: each fingerprint looks up the neighbours at one or two free bits."""
    fps = np.sort(fps)
    free = [np.uint64(1 << b) for b in range(64) if not mask >> b & 1]
    flips = free + [a | b for a, b in combinations(free, 2)]
    label = np.arange(len(fps))
    links = []
    for flip in flips:
        probe = fps ^ flip
        at = np.minimum(np.searchsorted(fps, probe), len(fps) - 1)
        own = np.flatnonzero(fps[at] == probe)
        own = own[own < at[own]]
        links.append((own, at[own]))
    a, b = (np.concatenate(x) for x in zip(*links))
    ok = linked(fps[a], fps[b])
    a, b = a[ok], b[ok]
    while True:
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (before == label).all():
            break
    away = label != np.arange(len(fps))
    return fps[away], fps[label[away]]


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mask, fps) rows to links (u, v)."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
        masks, found = batch.column(0).to_pylist(), []
        for n in np.unique(sizes):
            which = np.flatnonzero(sizes == n)
            if n <= 16:
                found.append(small_buckets(flat[at[which][:, None] + np.arange(n)]))
            else:
                found += [large_bucket(flat[at[k]:at[k + 1]], masks[k] & (1 << 64) - 1) for k in which]
        if found:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def classes(marked: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``marked`` (stored: it is read twice); ``root`` names
    the class, ``component_id`` is its smallest id."""
    nodes = stored(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "fingerprints")
    keyed = nodes.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in KEYS))).alias("mask"))
    buckets = (keyed.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
               .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("mask", "fps"))
    links = buckets.mapInArrow(bucket_links, "u long, v long")
    rooted = (nodes.join(roots(links).withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    rooted = stored(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, fingerprint (signed long ``fp``) and ``component_id``, the smallest id of its class."""
    marked = stored(with_fingerprint(docs.select(doc_id, text), text, keep=[doc_id]), "marked")
    return marked.join(classes(marked, doc_id), "fp").select(doc_id, "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each class, all columns as they came. Of rows that repeat that id in the
    class one stays: the least by text hash, of equal texts the least by a hash of all columns. A class of null ids only
    keeps one row in the same way.

    Rows are known by id and text hash, so what is stored and joined on the way holds no texts; the documents are
    shuffled once, for the join that picks them.
    """
    kd, kx, rank = free_name(docs, "_kd", "_kx", "_rank")
    keys = {kd: F.xxhash64(F.col(doc_id)), kx: F.xxhash64(F.col(text), F.col(doc_id).isNull())}
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *(c.alias(n) for n, c in zip(("kd", "kx"), keys.values())))
    marked = stored(with_fingerprint(keyed, "text", keep=["id", "kd", "kx"]), "marked")
    one = (marked.join(classes(marked, "id"), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
           .groupBy("root").agg(F.min(F.struct("kx", "kd")).alias("k")).select(F.col("k.kd").alias(kd), F.col("k.kx").alias(kx)))
    picked = docs.withColumns(keys).join(one, [kd, kx])
    first = F.row_number().over(Window.partitionBy(kd, kx).orderBy(F.xxhash64(*own_columns(docs))))
    return picked.withColumn(rank, first).where(F.col(rank) == 1).select(*own_columns(docs))
