"""Line deduplication with two Bloom filters.

A line's key is the line without white space at its ends, A-Z in lower case. A key of at least ``min_chars`` code points
loses its lines in every document but that with the smallest id that holds it.

1. Each task puts the hashes of its documents' keys into a *once* filter, and those that are there already into a *twice*
   filter. Filters of two tasks merge as once | once and twice | twice | (once & once). What travels is a block of 65,536
   bits at a time, as the places of its bits while these are few.
2. The merged *twice* filter, at most ``max_bits`` / 8 bytes, is broadcast. A second scan emits only keys that are in it.
3. These suspects are shuffled as text, so that equal keys, not equal hashes, decide on the first document that holds one.
4. Rows that lose lines are put into a third filter; only rows found there are shuffled to meet their line numbers. All
   other rows are finished in the scan.

Filters have 16 bits a line until ``max_bits``; beyond, more lines are suspects (in the end all), which costs shuffle and
changes no result. A row is known by hashes of its id and its text.

Null and empty texts are one empty line. Rows with the same id are one document. Rows with a null id are one document that
comes after all others. Repeated rows lose the same lines. Column names of the input don't matter.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import numbered, numbered_fields, stored

MIN_CHARS = 10
LINE_BITS, LEAST_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
#: Bits of a block; a place inside it takes two bytes.
BLOCK = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """Keys of enough code points to the numbers of their lines."""
    keys: dict[bytes, list[int]] = {}
    for k, line in enumerate(text.translate(LOWER).split(b"\n")):
        key = line.strip(BLANK)
        # a code point has four bytes at most
        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
            keys.setdefault(key, []).append(k)
    return keys


class Bits:
    """A Bloom filter of 2**n bits with two probes a hash."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def probes(self, hashes: np.ndarray) -> np.ndarray:
        """The second probe is made of the upper half and mixed once more, so that it tells more than the first."""
        second = (hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        return np.concatenate([hashes & self.mask, (second ^ second >> np.uint64(29)) & self.mask])

    def add(self, hashes: np.ndarray) -> None:
        at = self.probes(hashes)
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.probes(hashes)
        got = self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return (got[:len(hashes)] & got[len(hashes):]).astype(bool)

    def blocks(self) -> np.ndarray:
        return self.data.reshape(-1, min(len(self.data), BLOCK // 8))


def _encoded(block: np.ndarray) -> bytes:
    bits = np.flatnonzero(np.unpackbits(block, bitorder="little"))
    return bits.astype("<u2").tobytes() if 2 * len(bits) < len(block) else block.tobytes()


def _decoded(raw: bytes, size: int = BLOCK // 8) -> np.ndarray:
    if len(raw) == size:
        return np.frombuffer(raw, np.uint8)
    bits = np.zeros(8 * size, np.uint8)
    bits[np.frombuffer(raw, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


BLOCKS = "block int, once binary, twice binary"


def _block_rows(once: Bits, twice: Bits | None) -> Iterator[pa.RecordBatch]:
    a = once.blocks()
    b = a if twice is None else twice.blocks()
    full = np.flatnonzero(a.any(axis=1)).tolist()
    for k in range(0, len(full), 256):
        part = full[k:k + 256]
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array([_encoded(a[i]) for i in part], pa.binary()),
            pa.array([_encoded(b[i]) if twice is not None else b"" for i in part], pa.binary())], names=["block", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of all tasks to one row each; two bitmaps of each block of the partition are held."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = held.setdefault(block, [np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)])
            once = _decoded(once)
            own[1] |= own[0] & once | _decoded(twice)
            own[0] |= once
    for block, (once, twice) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_encoded(once)], pa.binary()),
                                          pa.array([_encoded(twice)], pa.binary())], names=["block", "once", "twice"])


def merged(blocks: DataFrame, bits: int, column: str) -> bytes:
    """The bytes of one of the two filters, at most ``MAX_BITS`` / 8 of them."""
    rows = blocks.repartition("block").mapInArrow(_merge, BLOCKS).select("block", column).collect()
    data = np.zeros(bits // 8, np.uint8)
    for r in rows:
        data[r["block"] * (BLOCK // 8):(r["block"] + 1) * (BLOCK // 8)] = _decoded(bytes(r[column]))
    return data.tobytes()


def bits_for(things: int, max_bits: int) -> int:
    return min(max_bits, max(LEAST_BITS, 1 << (LINE_BITS * things - 1).bit_length() if things else 0))


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def seen_twice(texts: DataFrame, bits: int, min_chars: int) -> bytes:
    """The twice filter of the one column of ``texts`` (binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bits(bits), Bits(bits)
        for batch in batches:
            found = [_hashes(line_keys(t or b"", min_chars)) for t in batch.column(0).to_pylist()]
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            twice.add(hashes[(n > 1) | once.holds(hashes)])
            once.add(hashes)
        yield from _block_rows(once, twice)

    return merged(texts.mapInArrow(run, BLOCKS), bits, "twice")


def seen(hashes: DataFrame, bits: int) -> bytes:
    """A filter of the one column of ``hashes`` (long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Bits(bits)
        for batch in batches:
            once.add(batch.column(0).to_numpy().view(np.uint64))
        yield from _block_rows(once, None)

    return merged(hashes.mapInArrow(run, BLOCKS), bits, "once")


def suspects(keyed: DataFrame, bits: int, twice: bytes, min_chars: int) -> DataFrame:
    """(key, id, rk, rx, at): keys of the twice filter, the row they are in and the numbers of their lines. ``keyed``: id,
    rk, rx, body."""
    shared = keyed.sparkSession.sparkContext.broadcast(twice)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", keyed.schema["id"].dataType),
                           T.StructField("rk", T.LongType()), T.StructField("rx", T.LongType()),
                           T.StructField("at", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bits(bits, shared.value)
        for batch in batches:
            keys, at, row = [], [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                for key, lines in line_keys(text or b"", min_chars).items():
                    keys.append(key)
                    at.append(lines)
                    row.append(k)
            pick = np.flatnonzero(held.holds(_hashes(keys))).tolist() if keys else []
            where = pa.array([row[i] for i in pick], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in pick], pa.binary()), *(batch.column(i).take(where) for i in range(3)),
                pa.array([at[i] for i in pick], pa.list_(pa.int32()))], names=schema.names)

    return keyed.mapInArrow(run, schema)


def lost_lines(keyed: DataFrame, lines: int, min_chars: int, max_bits: int) -> DataFrame:
    """(rk, rx, lost): rows that lose lines, with the lists of these. Stored."""
    bits = bits_for(lines, max_bits)
    twice = seen_twice(keyed.select("body"), bits, min_chars)
    found = stored(suspects(keyed, bits, twice, min_chars), "suspects")
    # both sides are stored, so that a key with very many rows can be split among tasks when they are joined
    first = stored(found.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1 AND first IS NOT NULL").drop("n"), "first")
    later = found.join(first, "key").where("id IS NULL OR id > first")
    return stored(later.groupBy("rk", "rx").agg(F.collect_set("at").alias("lost")), "lost")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                keep: list[str] | None = None, name: str = "lines", rest: bool = True, max_bits: int = MAX_BITS) -> DataFrame:
    """Add column ``name``: a struct of n_lines, n_dropped, kept_sha256, ``dropped`` (line numbers from 0) and, if ``rest``,
    ``kept``: the remaining text. Of the own columns only ``keep`` (None: all but the text) stay. The documents are read
    four times and only rows that may lose lines are shuffled."""
    own = docs.columns if keep is None else keep
    own = [c for c in own if c != text]
    keys = [F.xxhash64(F.col(doc_id), F.col(doc_id).isNull()).alias("rk"), F.xxhash64(F.col(text), F.col(text).isNull()).alias("rx"),
            F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")]
    keyed = docs.select(F.col(doc_id).alias("id"), *keys)
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    lines = docs.agg(F.coalesce(F.sum(breaks + 1), F.lit(0))).first()[0]
    lost = lost_lines(keyed, lines, min_chars, max_bits)
    rows = lost.count()
    bits = bits_for(rows, max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(seen(lost.select(F.xxhash64("rk", "rx")), bits))

    def may_lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bits(bits, shared.value)
        for batch in batches:
            hit = held.holds(batch.column("both").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "hit"])

    wide = docs.select(*numbered(docs, own), *keys).withColumn("both", F.xxhash64("rk", "rx"))
    marked = wide.mapInArrow(may_lose, T.StructType([*wide.schema.fields, T.StructField("hit", T.BooleanType())]))
    result = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                           T.StructField("kept_sha256", T.StringType()), T.StructField("dropped", T.ArrayType(T.IntegerType())),
                           *([T.StructField("kept", T.StringType())] if rest else [])])
    schema = T.StructType([*numbered_fields(docs, own), T.StructField("lines", result)])
    arrow = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()),
                       ("dropped", pa.list_(pa.int32())), *([("kept", pa.string())] if rest else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in zip(batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()):
                gone = sorted({k for at in found or () for k in at})
                n = body.count(b"\n") + 1
                if gone:
                    away = set(gone)
                    body = b"\n".join(x for k, x in enumerate(body.split(b"\n")) if k not in away)
                out.append({"n_lines": n, "n_dropped": len(gone), "kept_sha256": hashlib.sha256(body).hexdigest(),
                            "dropped": gone, **({"kept": body.decode("utf-8", "replace")} if rest else {})})
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(own)], pa.array(out, arrow)], names=schema.names)

    names = [f"c{k}" for k in range(len(own))]
    whole = marked.where("NOT hit").select(*names, "body", F.lit(None).cast("array<array<int>>").alias("lost"))
    cut = marked.where("hit").join(lost, ["rk", "rx"], "left").select(*names, "body", "lost")
    done = [x.mapInArrow(finish, schema) for x in (whole, cut)]
    return done[0].union(done[1]).toDF(*own, name)
