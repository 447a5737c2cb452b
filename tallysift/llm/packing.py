"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. A round credits each queue with its share of a window and serves it as many whole
grains as its credit holds; what is left of the credit, the deficit counter, is carried into the next round. Rounds
follow each other without a gap and are cut into windows of ``window`` tokens, so that every window is full and no
source is ever a grain away from its share of the rounds so far. A queue that is empty leaves its turn to the others.

Shares are integers over 2**20, so the deficit counter before round r is ``r * quantum mod 2**20`` in closed form: no
round has to be played to know where another stands. A task places any stretch of a queue by itself, from the queue's
length and the stretch's rank in its queue; that is how deficits pass from partition to partition without a scan over
all windows. What the driver holds is one row per source.

Jobs: (1) tokenize once, store ids with their rank inside (partition, source); (2) add up partitions per source;
(3) place. A hot source is spread over all partitions of the scan. The grains a source can't fill follow after the
last round, source by source. Null and empty texts are the end token alone, null sources are one queue, repeated rows
are packed as often as they come.
"""

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tallysift.llm.common import stored

UNIT = 1 << 20
#: The documented bound of what the driver holds: more sources than this need a coarser queue column.
MAX_QUEUES = 100_000
#: Texts of these characters are cut into words by ``re``; for them PLAIN cuts as the tokenizer's own pattern does.
COMMON = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+"
                   r"| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
CACHED_WORDS = 300_000


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian unsigned 16- or 32-bit numbers.

    Plain texts are cut into words whose ids are remembered; unknown words go through the same merges in tiktoken.
    Any other text, or one with a special token's name in it, goes through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        model = json.loads(self.whole.to_str())
        self.special = [t["content"] for t in model["added_tokens"]]
        vocab = model["model"]["vocab"]
        self.type = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        letters = {c: b for b, c in self._letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _letters() -> dict[int, str]:
        """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest
        from 256 on."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in own]
        return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def __call__(self, text: str) -> bytes:
        if not COMMON.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        known, out = self.known, []
        for word in PLAIN.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = np.array(self.words.encode_ordinary(word), self.type).tobytes()
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if len(word) < 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, doc_id: str, text: str, queue: str, end: int) -> DataFrame:
    """(part, queue, doc_id, rank, tokens, ids): rank counts the queue's tokens before it in this partition."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(queue).cast("string").alias("queue"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("queue", T.StringType()),
        T.StructField("doc_id", read.schema["doc_id"].dataType), T.StructField("rank", T.LongType()),
        T.StructField("tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, done = TaskContext.get().partitionId(), encoder(path), {}
        last = np.array([end], encode.type).tobytes()
        size = len(last)
        for batch in batches:
            queues, ids, ranks, counts = batch.column(1).to_pylist(), [], [], []
            for q, t in zip(queues, batch.column(2)):
                ids.append(encode(t.as_py()) + last)
                counts.append(len(ids[-1]) // size)
                ranks.append(done.get(q, 0))
                done[q] = ranks[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int64()), batch.column(1), batch.column(0), pa.array(ranks, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return read.mapInArrow(run, schema)


class Plan:
    """The schedule: queue lengths in tokens, their shares, and where each grain of a queue goes."""

    def __init__(self, lengths: dict, shares: dict | None, window: int, grain: int):
        self.window, self.grain = window, grain
        self.index = {q: k for k, q in enumerate(sorted(lengths, key=lambda q: (q is not None, q)))}
        tokens = [lengths[q] for q in self.index]
        wanted = [float(shares[q]) if shares else n for q, n in zip(self.index, tokens)]
        if not all(w > 0 for w in wanted):
            raise ValueError("every source needs a share above zero")
        self.grains = np.array([n // grain for n in tokens], np.int64)
        per_round = window // grain
        self.quantum = np.array([max(1, round(w / sum(wanted) * UNIT)) * per_round for w in wanted], np.int64)
        rest = np.array([n % grain for n in tokens], np.int64)
        self.tail = int(self.grains.sum()) * grain + np.concatenate([[0], np.cumsum(rest)[:-1]])

    def served(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Grains that the queue has had after so many rounds; what the credit holds beyond is its deficit counter."""
        return np.minimum(self.grains[queue], rounds * self.quantum[queue] // UNIT)

    def place(self, queue: int, grains: np.ndarray) -> np.ndarray:
        """First token's position, over all windows, of grains (numbers in the queue, rising)."""
        turn = -(-(grains + 1) * UNIT // self.quantum[queue]) - 1
        rounds, inverse = np.unique(turn, return_inverse=True)
        before = np.zeros(len(rounds), np.int64)
        for q in range(len(self.grains)):
            before += self.served(q, rounds)
            if q < queue:
                before += self.served(q, rounds + 1) - self.served(q, rounds)
        at = before[inverse] + grains - self.served(queue, rounds)[inverse]
        return at * self.grain

    def pieces(self, queue: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset in the stretch, length, position) of the pieces that ``n`` tokens from the queue's token ``first``
        are cut into."""
        g, whole = self.grain, int(self.grains[queue])
        numbers = np.arange(first // g, (first + n - 1) // g + 1)
        inside = numbers < whole
        position = np.full(len(numbers), self.tail[queue], np.int64)
        position[inside] = self.place(queue, numbers[inside])
        begin = np.maximum(numbers * g, first)
        stop = np.minimum((numbers + 1) * g, first + n)
        position += begin - numbers * g
        # the tail isn't aligned: cut it where a window ends
        cut = position // self.window != (position + (stop - begin) - 1) // self.window
        if cut.any():
            k = np.flatnonzero(cut)
            head = self.window - position[k] % self.window
            position = np.insert(position, k + 1, position[k] + head)
            stop_ = stop[k].copy()
            stop[k] = begin[k] + head
            stop, begin = np.insert(stop, k + 1, stop_), np.insert(begin, k + 1, begin[k] + head)
        joined = (position[1:] == position[:-1] + (stop - begin)[:-1]) & (position[1:] % self.window != 0)
        lead = np.concatenate([[True], ~joined])
        starts = np.flatnonzero(lead)
        length = np.add.reduceat(stop - begin, starts)
        return begin[starts] - first, length, position[starts]


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in (
    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", queue: str = "source",
         shares: dict | None = None, window: int = 1024, grain: int = 128, end: int = 0, ids: bool = True) -> DataFrame:
    """Pack all documents; one row per piece: doc_id, PIECES (``ids`` little-endian unsigned 32-bit; left out on wish).

    ``shares``: target proportion of each source's tokens; by default what the sources have, so that all queues end
    together. ``grain`` divides ``window``: the least that a source is served at once.
    """
    if window % grain:
        raise ValueError("grain must divide window")
    held = stored(tokenized(docs, tokenizer, doc_id, text, queue, end), "tokens")
    parts = stored(held.groupBy("queue", "part").agg(F.sum("tokens").alias("n")), "parts")
    sums = parts.groupBy("queue").agg(F.sum("n").alias("n")).limit(MAX_QUEUES + 1).collect()
    if len(sums) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources: pass a coarser queue column")
    # running totals in two steps, so that no task sees all partitions of a queue: blocks of parts, then inside a block
    block = (F.col("part") / F.lit(4096)).cast("long")
    blocks = parts.groupBy("queue", block.alias("block")).agg(F.sum("n").alias("n"))
    ahead = blocks.select("queue", "block", F.coalesce(F.sum("n").over(
        Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    base = (parts.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("n").over(
        Window.partitionBy("queue", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .alias("p").join(ahead.alias("a"), F.expr("p.queue <=> a.queue AND p.block = a.block"))
        .selectExpr("p.queue", "p.part", "inside + ahead AS base"))
    ranked = held.alias("h").join(base.alias("b"), F.expr("h.queue <=> b.queue AND h.part = b.part")).selectExpr(
        "h.doc_id", "h.queue", "h.rank + b.base AS first", "h.tokens", "h.ids")
    schedule = docs.sparkSession.sparkContext.broadcast(Plan({r.queue: r.n for r in sums}, shares, window, grain) if sums else None)
    wide = encoder_type(tokenizer)
    fields = [f for f in PIECES.fields if ids or f.name != "ids"]
    schema = T.StructType([T.StructField("doc_id", held.schema["doc_id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plan, rows = schedule.value, []
            which, bodies = [], []
            for k, (q, first, n, body) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 5)))):
                start, length, position = plan.pieces(plan.index[q], first, n)
                body = np.frombuffer(body, wide).astype("<u4").tobytes()
                parts_ = [body[4 * s:4 * (s + m)] for s, m in zip(start.tolist(), length.tolist())]
                rows.append(np.stack([start, length, np.array([zlib.crc32(p) for p in parts_], np.int64),
                                      np.full(len(start), n), position // window, position % window]))
                which += [k] * len(start)
                if ids:
                    bodies += parts_
            if rows:
                columns = [batch.column(0).take(pa.array(which))] + [pa.array(c) for c in np.concatenate(rows, axis=1)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(bodies, pa.binary())] if ids else []), names=schema.names)

    return ranked.mapInArrow(run, schema)


def encoder_type(path: str) -> str:
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, length, ids) from pieces with their ids; a window's pieces are one group."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"),
                                            F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("s"))
    return own.select("sequence_id", "length", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
