"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` words (a shorter item is one window). Patterns of one length m
share two tables. The shift table tells for a block of two words how far the text may be skipped: m - 1 if the block
is in no pattern, else its least distance to a pattern's end. Where the shift is zero, the bucket of that block's hash
names the patterns that end with it, and the words themselves are compared. Many stretches of text are scanned at
once: every step looks at one block per stretch and moves each by its own shift.

The benchmark is taken in blocks of at most about ``block_bytes`` of text; each block's tables are broadcast and all
documents pass them, so neither a large benchmark nor a hot document needs a shuffle. Null texts have no words; null
ids of items count as hits but name no item; items without words are no pattern.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import free_name, numbered, numbered_fields, own_columns, stored

#: Bytes of words keep themselves, A-Z in lower case; all others become 0.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
#: Words of a stretch that is scanned by one cursor, and bytes of text scanned at once.
STRETCH, PIECE = 256, 1 << 22
_rng = np.random.default_rng(7)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[0] = 0
_BASE, _LEFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
    return _powers[0], _powers[1]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; ``data`` has gone through WORDS."""
    a = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], a != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power(len(a) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[a] * power[:len(a)])])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, h ^ (h >> np.uint64(29))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a block of two words; a block of one word has first = second."""
    x = (first * _LEFT + second) * _BASE
    return x ^ (x >> np.uint64(31))


class Searcher:
    """Tables for the patterns of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], items: list[list[str]]):
        self.patterns, self.items, self.m = patterns, items, len(patterns[0])
        self.block = min(2, self.m)
        hashes = words_of(b"\0".join(b"\0".join(p) for p in patterns))[2].reshape(len(patterns), self.m)
        self.bits = np.uint64(max(12, (8 * len(patterns) * self.m).bit_length()))
        self.shift = np.full(1 << int(self.bits), self.m - self.block + 1, np.int64)
        for end in range(self.block - 1, self.m):
            blocks = self._slot(mixed(hashes[:, end - self.block + 1], hashes[:, end]))
            np.minimum.at(self.shift, blocks, self.m - 1 - end)
        last = mixed(hashes[:, self.m - self.block], hashes[:, self.m - 1])
        self.order = np.argsort(last, kind="stable")
        self.suffixes = last[self.order]
        self.heads = hashes[self.order, 0]

    def _slot(self, mix: np.ndarray) -> np.ndarray:
        return mix >> (np.uint64(64) - self.bits)

    def candidates(self, h: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end word, pattern) pairs whose last block and first word agree. Each stretch holds the words
        firsts[i] .. lasts[i] - 1, of which windows may end anywhere from the m-th on."""
        at, stop = firsts + self.m - 1, lasts
        ends = []
        while True:
            alive = at < stop
            at, stop = at[alive], stop[alive]
            if not len(at):
                break
            jump = self.shift[self._slot(mixed(h[at - self.block + 1], h[at]))]
            ends.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
        p = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        mix = mixed(h[p - self.block + 1], h[p])
        low, high = (np.searchsorted(self.suffixes, mix, side) for side in ("left", "right"))
        n = high - low
        p, k = np.repeat(p, n), np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = self.heads[k] == h[p - self.m + 1]
        return p[same], self.order[k[same]]


def searchers(items: list[tuple[str | None, str | None]], window: int) -> list[Searcher]:
    """Tables by pattern length for (id, text) pairs."""
    found: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        words = (text or "").encode().translate(WORDS).replace(b"\0", b" ").split()
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[k:k + window])].add(item)
    by_length = defaultdict(list)
    for pattern in sorted(found):
        by_length[len(pattern)].append(pattern)
    return [Searcher(p, [sorted(x for x in found[w] if x is not None) for w in p]) for _, p in sorted(by_length.items())]


def scan(texts: list[bytes | None], tables: list[Searcher]) -> list[tuple[int, list[tuple[int, int]], set]]:
    """Per text: number of words, runs of hit words (from, to) and ids of the items that occur."""
    data = b"\0".join(t or b"" for t in texts).translate(WORDS)
    starts, ends, h = words_of(data)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    bound = np.searchsorted(starts, begins)
    n_words = np.diff(bound)
    marks, items = np.zeros(len(h) + 1, np.int64), defaultdict(set)
    for table in tables:
        n = np.maximum(0, n_words - table.m + 1)
        parts = -(-n // STRETCH)
        doc = np.repeat(np.arange(len(texts)), parts)
        k = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
        first = bound[doc] + k * STRETCH
        last = np.minimum(first + STRETCH + table.m - 1, bound[doc + 1])
        for p, q in zip(*(x.tolist() for x in table.candidates(h, first, last))):
            s = p - table.m + 1
            if tuple(data[starts[s]:ends[p]].replace(b"\0", b" ").split()) == table.patterns[q]:
                marks[s] += 1
                marks[p + 1] -= 1
                items[int(np.searchsorted(bound, p, "right")) - 1].update(table.items[q])
    hit = np.cumsum(marks[:-1]) > 0
    out = []
    for i in range(len(texts)):
        own = hit[bound[i]:bound[i + 1]]
        runs = []
        if own.any():
            padded = np.concatenate([[False], own, [False]])
            cut = np.flatnonzero(padded[1:] != padded[:-1]).tolist()
            runs = list(zip(cut[::2], cut[1::2]))
        out.append((int(n_words[i]), runs, items.get(i, set())))
    return out


def joined_runs(a: list, b: list) -> list[tuple[int, int]]:
    """Union of two lists of runs."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, [*a, *b])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])
_FOUND = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))),
    ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
])


def _pieces(sizes: list[int]) -> Iterator[slice]:
    """Slices of at most PIECE bytes, or one text."""
    first = total = 0
    for k, n in enumerate(sizes):
        if k > first and total + n > PIECE:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if len(sizes) > first:
        yield slice(first, len(sizes))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 13, name: str = "found", keep: list[str] | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Add column ``name``, a struct of FOUND: counts, runs of hit words, ids and the verdict (at least a twentieth of
    the words hit). Of the own columns only ``keep`` (None: all) stay."""
    spark, own = docs.sparkSession, docs.columns if keep is None else keep
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes) or 1
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    current = docs.select(*numbered(docs, own), F.col(text).cast("binary").alias("src"), F.lit(None).cast(FOUND).alias("found"))
    schema = T.StructType([*numbered_fields(docs, own), T.StructField("src", T.BinaryType()), T.StructField("found", FOUND)])
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        tables = spark.sparkContext.broadcast(searchers([(r.i, r.t) for r in part], window))

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, before = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()
                found = []
                for piece in _pieces([len(t or b"") for t in texts]):
                    for old, (n, runs, names) in zip(before[piece], scan(texts[piece], tables.value)):
                        if old:
                            runs, names = joined_runs(old["runs"], runs), names | set(old["items"])
                        hit, names = sum(e - s for s, e in runs), sorted(names)
                        found.append({
                            "n_words": n, "n_hit": hit, "n_items": len(names), "runs": runs, "items": names,
                            "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                            "contaminated": hit > 0 and 20 * hit >= n})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _FOUND)], names=schema.names)

        current = current.mapInArrow(run, schema)
        if block + 1 < blocks:
            current = stored(current, "block")
    return current.drop("src").toDF(*own, name)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    name = free_name(docs, "_found")[0]
    return find(docs, benchmark, text, name=name, **options).where(~F.col(name)["contaminated"]).select(*own_columns(docs))
