"""Ranked lexical search by norm buckets over impact vectors.

A document's impact of a term is the term's weight times its saturated frequency, so a score is the inner product of a
query's term counts and the document's impacts, in 64-bit integers. Only terms that some query has matter.

1. One scan turns texts into (term numbers, frequencies), stored; sums over all of them give N, L and document frequencies.
2. Vectors get their length (2-norm of the impacts) and are stored in descending length within each task.
3. The longest vectors are searched first; the ``k``-th best score of each query among them is its threshold everywhere.
4. All vectors long enough for any query (a filter on the stored lengths) are searched in buckets of ``BUCKET`` vectors:
   a bucket is skipped for a query when its greatest length times the query's length stays below the threshold
   (Cauchy-Schwarz). Inside, the query's coordinates are taken one by one, heaviest first; a vector stays while the products
   so far plus the product of the two remaining lengths can reach the threshold. What survives is scored in integers.
   Thresholds rise as a task finds better documents, and ties are kept, so results are exact.

Queries come in blocks of at most ``BLOCK_BYTES`` of text; what a task holds is bounded by a block.

Null and empty texts have no terms; documents without terms count nowhere. Queries without terms find nothing. A query row
is a query of its own, also where ids repeat; repeated documents are ranked one by one. Null ids come last among equals.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import stored

K = 20
BUCKET = 1024
#: Vectors searched first for thresholds, about.
HEADS = 8192
BLOCK_BYTES = 4 << 20
COORDINATES = 8
#: Lengths and products of lengths are doubles; this much is allowed for.
SLACK = 1 + 1e-9
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z in lower case, all other bytes below 128 that aren't letters or digits to blanks.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


class Queries:
    """A block of queries over one numbering of their terms."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts = [], []
        for text in texts:
            at = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text)]
            found, n = np.unique(np.array(at, np.int64), return_counts=True)
            self.terms.append(found)
            self.counts.append(n.astype(np.int64))
        self.lengths = np.array([math.sqrt(float(c @ c)) for c in self.counts])


#: Number of all terms, numbers of the queries' terms, their frequencies.
VECTORS = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
           T.StructField("tfs", T.ArrayType(T.IntegerType()))]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(id, n, terms, tfs): all terms counted, those of the vocabulary by number with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *VECTORS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, found, times = [], [], []
            for body in batch.column(1):
                words = (body.as_py() or b"").translate(TERMS).split()
                at, n = np.unique(np.fromiter((k for k in map(number, words) if k is not None), np.int32), return_counts=True)
                sizes.append(len(words))
                found.append(at)
                times.append(n)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            flat = [pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32)) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()),
                                              *(pa.ListArray.from_arrays(ends, x) for x in flat)], names=schema.names)

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, schema)


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents by term; each task sends a row per term it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(size, np.int64)
    for r in found:
        df[r["term"]] = r["df"]
    return df


class Weights:
    """Impacts in 64-bit integers: weight * (10**9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L."""

    def __init__(self, documents: int, total: int, df: np.ndarray):
        self.documents, self.total = documents, total
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def impacts(self, n: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = np.repeat(75 + (25 * n * self.documents) // self.total, sizes)
        return self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, sizes, terms and frequencies of a batch with ``VECTORS`` from column ``at`` on."""
    n = batch.column(at).to_numpy(zero_copy_only=False)
    lists, tfs = batch.column(at + 1), batch.column(at + 2)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, tfs)]
    return n, sizes, *flat


def with_length(held: DataFrame, weights: Weights) -> DataFrame:
    """Add ``length`` in front of the vectors' columns."""
    shared = held.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField("length", T.DoubleType()), *held.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, at, tf = _unpacked(batch, 1)
            row = np.repeat(np.arange(len(n)), sizes)
            x = shared.value.impacts(n, sizes, at, tf).astype(float)
            length = np.sqrt(np.bincount(row, x * x, minlength=len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(length), *batch.columns], names=schema.names)

    return held.mapInArrow(run, schema)


class Bucket:
    """Vectors side by side, by row and by term."""

    def __init__(self, length: np.ndarray, sizes: np.ndarray, at: np.ndarray, impact: np.ndarray):
        self.length, self.sizes, self.at, self.impact = length, sizes, at, impact
        self.begin = np.cumsum(sizes) - sizes
        self.longest = float(length.max(initial=0))
        order = np.argsort(at, kind="stable")
        self.term, first = np.unique(at[order], return_index=True)
        self.first = np.append(first, len(at))
        self.row, self.value = np.repeat(np.arange(len(length)), sizes)[order], impact[order]
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.int64)

    def survivors(self, terms: np.ndarray, counts: np.ndarray, length: float, threshold: float) -> np.ndarray:
        """Rows that may score ``threshold`` (more than 0) or more."""
        slot = np.searchsorted(self.term, terms)
        there = slot < len(self.term)
        there[there] = self.term[slot[there]] == terms[there]
        slot, counts = slot[there], counts[there]
        rows = np.flatnonzero(self.length * length * SLACK >= threshold)
        if not len(slot) or not len(rows):
            return rows[:0]
        gain = counts * self.most[slot]
        heavy = np.argsort(-gain, kind="stable")
        done, left, rest = np.zeros(len(rows)), self.length[rows] ** 2, float(counts @ counts)
        for f in heavy[:COORDINATES]:
            k = slot[f]
            column = np.zeros(len(self.length))
            column[self.row[self.first[k]:self.first[k + 1]]] = self.value[self.first[k]:self.first[k + 1]]
            x = column[rows]
            done = done + counts[f] * x
            left = np.maximum(left - x * x, 0)
            rest = max(rest - float(counts[f]) ** 2, 0.0)
            # what differences of squares lose is within 1e-7 of the lengths
            ok = (done + math.sqrt(rest) * np.sqrt(left)) * SLACK + 1e-7 * length * self.length[rows] >= threshold
            rows, done, left = rows[ok], done[ok], left[ok]
            if not len(rows):
                break
        return rows

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; ``dense``: the query's counts by term."""
        n = self.sizes[rows]
        at = np.repeat(self.begin[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.concatenate([[0], np.cumsum(dense[self.at[at]] * self.impact[at])])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]


class Best:
    """The best rows of one query so far; ``bar`` is what a further row must reach."""

    def __init__(self, k: int, bar: int):
        self.k, self.bar = k, max(1, bar)
        self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, row: np.ndarray, ids) -> None:
        good = score >= self.bar
        self.score, self.row = np.concatenate([self.score, score[good]]), np.concatenate([self.row, row[good]])
        if len(self.score) > self.k:
            self.cut(ids)

    def cut(self, ids) -> None:
        kth = np.partition(self.score, -self.k)[-self.k]
        above, ties = np.flatnonzero(self.score > kth), np.flatnonzero(self.score == kth)
        if len(above) + len(ties) > self.k:
            ties = np.array(heapq.nsmallest(self.k - len(above), ties.tolist(), key=lambda i: ids(int(self.row[i]))), np.int64)
        pick = np.concatenate([above, ties])
        self.score, self.row, self.bar = self.score[pick], self.row[pick], max(self.bar, int(kth))


def search(stored_vectors: DataFrame, queries: Queries, weights: Weights, bars: np.ndarray, k: int) -> DataFrame:
    """(query, score, id): each task's best ``k`` rows of every query among those that reach the query's bar."""
    shared = stored_vectors.sparkSession.sparkContext.broadcast((queries, weights, bars))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("score", T.LongType()),
                           T.StructField("id", stored_vectors.schema["id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, given, least = shared.value
        best = [Best(k, int(b)) for b in least]
        live = [q for q, found in enumerate(asked.terms) if len(found)]
        dense, kept, begins = np.zeros(len(asked.vocabulary), np.int64), [], [0]

        def order(row: int) -> tuple:
            part = int(np.searchsorted(begins, row, "right")) - 1
            v = kept[part][row - begins[part]].as_py()
            return (v is None, v.encode() if isinstance(v, str) else v if v is not None else 0)

        for batch in batches:
            kept.append(batch.column(1))
            length = batch.column(0).to_numpy(zero_copy_only=False)
            n, sizes, at, tf = _unpacked(batch, 2)
            impact = given.impacts(n, sizes, at, tf)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for a in range(0, len(n), BUCKET):
                z = min(a + BUCKET, len(n))
                bucket = Bucket(length[a:z], sizes[a:z], at[edge[a]:edge[z]], impact[edge[a]:edge[z]])
                for q in live:
                    if bucket.longest * asked.lengths[q] * SLACK < best[q].bar:
                        continue
                    rows = bucket.survivors(asked.terms[q], asked.counts[q], asked.lengths[q], best[q].bar)
                    if len(rows):
                        dense[asked.terms[q]] = asked.counts[q]
                        best[q].add(bucket.scores(rows, dense), begins[-1] + a + rows, order)
                        dense[asked.terms[q]] = 0
            begins.append(begins[-1] + len(n))
        ids = pa.chunked_array(kept) if kept else None
        for q, b in enumerate(best):
            if len(b.score):
                own = ids.take(pa.array(b.row)).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), q)), pa.array(b.score), own], names=schema.names)

    return stored_vectors.mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """Queries in blocks, streamed to the driver partition by partition."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(row["t"] or "")
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n + 16
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES, heads: int = HEADS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of every item."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    out = None
    for block in _blocks(items, item_id, item_text, block_bytes):
        queries = Queries([t for _, t in block])
        held = stored(vectors(docs, queries.vocabulary, doc_id, text), "vectors")
        documents, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        weights = Weights(documents, total, document_frequencies(held, len(queries.vocabulary)))
        sorted_ = stored(with_length(held.where("size(terms) > 0"), weights).sortWithinPartitions(F.desc("length")), "lengths")
        n = sorted_.count()
        cut = sorted_.agg(F.percentile_approx("length", max(0.0, 1 - heads / max(n, 1)), 10_000)).first()[0] if n else 0.0
        none = np.ones(len(block), np.int64)
        first = _ranked(search(sorted_.where(F.col("length") >= F.lit(cut)), queries, weights, none, k), k)
        bars = none.copy()
        for r in first.where(F.col("rank") == k).select("query", "score").collect():
            bars[r["query"]] = r["score"]
        live = queries.lengths > 0
        # a shorter vector can't reach any bar
        least = float((bars[live] / queries.lengths[live]).min()) / SLACK if live.any() else 0.0
        found = _ranked(search(sorted_.where(F.col("length") >= F.lit(least)), queries, weights, bars, k), k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)],
                                      T.StructType([T.StructField("query", T.LongType()), schema["item_id"]]))
        part = found.join(F.broadcast(names), "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out
