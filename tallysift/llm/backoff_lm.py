"""Language-model scores by a weighted backoff automaton.

Tokens are lower-cased words and an end. The unigram of every training word is in the model, and so is every 2- and
3-gram that occurs at least ``least`` = 2 times in the training texts (of a 3-gram also both 2-grams, which follows), so
the model grows with the corpus. Probabilities are discounted counts, and what the discount and the dropped n-grams
leave is spread over the shorter history's words, so that each history's probabilities add up to one; below all is the
add-one unigram.

The automaton has a state per kept history, an arc per kept n-gram with its log10 probability and the next state, and
from each state a failure arc to the next shorter history with its backoff weight. Where a state has no arc for a word
the failure arcs are followed down to the root, whose arcs are the unigrams.

No part of it is held whole. Each partition is cut into chunks of about ``CHUNK_BYTES`` of text; every chunk asks for the
words, then the 2-grams, then the 3-grams it has (never one per token or document), gets the counts and the backoff
weights of those alone, and builds its own part of the automaton of them. All texts of a chunk are then read left to
right side by side, each with its own state.

Questions go by hash to as many parts as there are chunks, as one row per chunk and part with its keys sorted and
compressed; the answer is a row of as many values in the same order and doesn't repeat the keys, which the chunk makes
again from its texts, which are kept as places in its list of words. 3-grams go to the part of their 2-gram, which adds up what is behind it; histories of one word have
too much behind them for that, so it is added up in the chunks that asked first for a 2-gram, then over these.
Frequent words have small numbers, and kept 2-grams are asked about by their rank in their part, so that keys take few bytes.

Null and empty texts have the end token only; repeated rows count each time;
without training rows every token has probability one of the unknown.
"""

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import id_crc, numbered, numbered_fields, stored

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CHUNK_BYTES = 8 << 20
DISCOUNT = 0.75
ROOT, START = 0, 1
#: Words that a text reads one after another; longer texts are read in stretches.
STRETCH = 512
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Numbers of the end, of the start and the least of a word; unseen words and words seen once have none.
END_NUMBER, START_NUMBER, FIRST_NUMBER, UNSEEN, ONCE = 0, 1, 2, -1, -2
BITS = 31
LAST = (1 << BITS) - 1


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def laid_bytes(*columns: np.ndarray) -> bytes:
    """Columns of longs in few bytes: first all lowest bytes, then the next, so that small numbers cost little."""
    x = np.stack([np.asarray(c).astype(np.int64) for c in columns])
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes(),
                       codec="zstd", asbytes=True)


def read_longs(data: bytes, columns: int, size: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=columns * size * 8, codec="zstd", asbytes=True)
    x = np.frombuffer(raw, np.uint8).reshape(columns, 8, size).transpose(0, 2, 1)
    return np.ascontiguousarray(x).view(np.int64).reshape(columns, size)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def laid_rising(x: np.ndarray) -> bytes:
    return laid_bytes(np.diff(x, prepend=np.int64(0)))


def read_rising(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(read_longs(data, 1, size)[0])


def read_each(data: bytes, size: int) -> np.ndarray:
    return read_longs(data, 1, size)[0]


def laid_reply(step: int, reply: np.ndarray) -> bytes:
    """Ranks rise with the 2-grams kept, and those of words from the frequent words to the rare, so their steps are laid."""
    if step == WORDS:
        order = np.argsort(-reply[0], kind="stable")
        return laid_bytes(reply[0], np.diff(reply[1][order], prepend=np.int64(0)))
    if step == PAIRS:
        n, first, rank = reply
        counts = laid_bytes(2 * n + first)
        return len(counts).to_bytes(4, "little") + counts + laid_rising(rank[n > 0])
    return laid_bytes(*reply)


def read_reply(step: int, data: bytes, size: int) -> np.ndarray:
    if step == WORDS:
        n, steps = read_longs(data, 2, size)
        rank = np.empty(size, np.int64)
        rank[np.argsort(-n, kind="stable")] = np.cumsum(steps)
        return np.stack([n, rank])
    if step == PAIRS:
        end = 4 + int.from_bytes(data[:4], "little")
        n, rank = read_longs(data[4:end], 1, size)[0], np.zeros(size, np.int64)
        rank[n > 1] = read_rising(data[end:], int((n > 1).sum()))
        return np.stack([n >> 1, n & 1, rank])
    return read_longs(data, REPLIES[step], size)


def laid_grams(grams: np.ndarray) -> bytes:
    """Sorted 2-grams: how much the first word grows, and the second word, less the one before after the same first word.
    Frequent words have small numbers, which a difference of whole 2-grams would lose."""
    first, last = np.diff(grams >> BITS, prepend=np.int64(0)), grams & LAST
    return laid_bytes(first, np.where(first == 0, np.diff(last, prepend=np.int64(0)), last))


def read_grams(data: bytes, size: int) -> np.ndarray:
    first, last = read_longs(data, 2, size)
    total = np.cumsum(last)
    begin = np.maximum.accumulate(np.where(first != 0, np.arange(size), 0))
    return (np.cumsum(first) << BITS) + total - (total - last)[begin]


class Head:
    """Numbers of words for an automaton in memory; the end and the start of a text have the two numbers after them."""

    def __init__(self, words: list[bytes]):
        self.ids = {w: k for k, w in enumerate(words)}
        self.end, self.start, self.size = len(words), len(words) + 1, len(words) + 2

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """Numbers of start, words and end; -1 for other words."""
        get = self.ids.get
        return np.array([self.start, *(get(w, -1) for w in words), self.end], np.int64)


class Automaton:
    """States, arcs and failure arcs. ``unigrams``: log10 probabilities by head number; ``history``: how often each
    head number is followed by a token; ``pairs`` and ``triples``: counts by gram."""

    def __init__(self, head: Head, unigrams: np.ndarray, history: np.ndarray, pairs: dict[int, int], triples: dict[int, int]):
        self.head = head
        size = head.size
        self.fail, self.backoff, self.arcs = [ROOT, ROOT], [0.0, 0.0], [{}, {}]
        self.of_word = {head.start: START}
        for gram in pairs:
            first = gram // size
            if first not in self.of_word:
                self.of_word[first] = self._state(ROOT)
        of_pair = {}
        for gram in triples:
            if gram // size not in of_pair:
                of_pair[gram // size] = self._state(self.of_word.get(gram // size % size, ROOT))
        single = 10.0 ** unigrams
        left = {s: [1.0, 1.0] for s in range(len(self.fail))}
        for gram, n in pairs.items():
            first, word = divmod(gram, size)
            state, p = self.of_word[first], (n - DISCOUNT) / history[first]
            self.arcs[state][word] = (float(np.log10(p)), of_pair.get(gram, self.of_word.get(word, ROOT)))
            left[state][0] -= p
            left[state][1] -= single[word]
        self._settle(left, set(self.of_word.values()))
        for gram, n in triples.items():
            pair, word = divmod(gram, size)
            state, p = of_pair[pair], (n - DISCOUNT) / pairs[pair]
            shorter = self._log(self.fail[state], word, unigrams)
            after = of_pair.get(pair % size * size + word, self.of_word.get(word, ROOT))
            self.arcs[state][word] = (float(np.log10(p)), after)
            left[state][0] -= p
            left[state][1] -= 10.0 ** shorter
        self._settle(left, set(of_pair.values()))

    def _state(self, fail: int) -> int:
        self.fail.append(fail)
        self.backoff.append(0.0)
        self.arcs.append({})
        return len(self.fail) - 1

    def _settle(self, left: dict, states: set) -> None:
        for s in states:
            mass, rest = left[s]
            self.backoff[s] = float(np.log10(max(mass, 1e-12) / max(rest, 1e-12)))

    def _log(self, state: int, word: int, unigrams: np.ndarray) -> float:
        total = 0.0
        while state != ROOT:
            arc = self.arcs[state].get(word)
            if arc is not None:
                return total + arc[0]
            total += self.backoff[state]
            state = self.fail[state]
        return total + unigrams[word]

    def score(self, numbers: list[int], unigrams: list[float]) -> float:
        """log10 probability of tokens given by head numbers (-1: none) and unigram log10 probabilities."""
        arcs, fail, backoff, of_word = self.arcs, self.fail, self.backoff, self.of_word
        state, total = START, 0.0
        for word, single in zip(numbers, unigrams):
            while state:
                arc = arcs[state].get(word)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += backoff[state]
                state = fail[state]
            else:
                total += single
                state = of_word.get(word, ROOT)
        return total


class Unigrams:
    """Counts and log10 probabilities of the words of a chunk. ``numbers``: sorted, of words seen twice or more."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, ends: int, tokens: int, types: int):
        self.numbers, self.values = np.concatenate([[END_NUMBER, START_NUMBER], numbers]), np.concatenate([[ends, ends], counts])
        self.total = tokens + types + 1
        self.norm = float(np.log10(self.total))

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often a word occurs, which is also how often a token follows it."""
        return np.where(numbers >= 0, self.values[places(self.numbers, numbers)], numbers == ONCE)

    def logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1.0) - self.norm


def column_of(table: pa.Table, k: int) -> np.ndarray:
    """Null doubles are NaN."""
    return table.column(k).combine_chunks().to_numpy(zero_copy_only=False)


def ended_pairs(s: np.ndarray) -> np.ndarray:
    """Where a 2-gram ends whose words both have numbers."""
    return (np.flatnonzero((s[1:] != START_NUMBER) & (s[1:] >= 0) & (s[:-1] >= 0)) + 1).astype(np.int32)


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """The stable order by part; short integers are sorted by radix."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in the sorted ``keys`` each wanted one is; -1: nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


BLOCKS = "step int, part int, chunk long, size int, keys binary, n binary"
ANSWERS = "step int, part int, chunk long, size int, reply binary, tokens long, types long"
WORDS, PAIRS, SINGLES, DOUBLES, TRIPLES = range(1, 6)
#: Numbers per key in the question and in the answer.
ASKED = {WORDS: 2, PAIRS: 1, SINGLES: 3, DOUBLES: 1, TRIPLES: 2}
REPLIES = {WORDS: 2, PAIRS: 3, SINGLES: 3, DOUBLES: 3, TRIPLES: 1}


QUESTION = pa.list_(pa.struct([("step", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("size", pa.int32()),
                               ("keys", pa.binary()), ("n", pa.binary())]))


def word_texts(parts: int):
    """Texts as places of their words among those of their chunk, sorted by part and word; the first row of a chunk also
    has the question for these words. A chunk is what follows in the table until ``CHUNK_BYTES`` are reached. The last two
    columns are the training flag and the bytes."""
    def settle(chunk: int, ids: dict, rows: list, found: list) -> pa.RecordBatch:
        own = pa.Table.from_batches(rows).combine_chunks()
        train = own.column(own.num_columns - 1).to_pylist()
        words = sorted(ids)
        part = np.array([*map(crc32, words)], np.int64) % parts
        order = np.argsort(part, kind="stable")
        place, n = np.empty(len(ids), np.int64), np.zeros(len(ids), np.int64)
        place[np.array([*map(ids.__getitem__, words)], np.int64)[order]] = np.arange(len(ids))
        seqs = []
        for f, t in zip(found, train):
            f = place[f]
            seqs.append(laid_bytes(f))
            if t:
                np.add.at(n, f, 1)
        edges, order = np.searchsorted(part[order], np.arange(parts + 1)).tolist(), order.tolist()
        asked = []
        for p, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            if z > a:
                text = b" ".join([words[k] for k in order[a:z]])
                asked.append({"step": WORDS, "part": p, "chunk": chunk, "size": z - a, "keys": pa.compress(text, codec="zstd", asbytes=True),
                              "n": laid_bytes(n[a:z], np.full(z - a, len(text)))})
        return pa.RecordBatch.from_arrays(
            [*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns), pa.array(np.full(len(found), chunk)),
             pa.array([len(f) for f in found], pa.int64()), pa.array(seqs, pa.binary()), pa.array([asked] + [None] * (len(found) - 1), QUESTION)],
            names=[*own.column_names, "chunk", "length", "seq", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, found, ids, size = TaskContext.get().partitionId() << 32, [], [], defaultdict(), 0
        ids.default_factory = ids.__len__
        for batch in batches:
            bodies, at = batch.column(batch.num_columns - 1), 0
            own = batch.select(list(range(batch.num_columns - 1)))
            for k in range(batch.num_rows):
                body = bodies[k].as_py()
                found.append(np.array([*map(ids.__getitem__, words_in(body))], np.int32))
                size += len(body)
                if size >= CHUNK_BYTES:
                    yield settle(chunk, ids, [*rows, own.slice(at, k + 1 - at)], found)
                    chunk, rows, found, ids, size, at = chunk + 1, [], [], defaultdict(), 0, k + 1
                    ids.default_factory = ids.__len__
            if at < batch.num_rows:
                rows.append(own.slice(at))
        if found:
            yield settle(chunk, ids, rows, found)
    return run


class Texts:
    """The texts of a chunk, and the answers it has so far: counts of its words, 2- and 3-grams, sums of histories."""

    def __init__(self, rows: pa.Table, parts: int, answers: pa.Table, ends: int, tokens: int, types: int):
        self.chunk, self.parts = rows.column("chunk")[0].as_py(), parts
        self.train = rows.column("train").to_numpy().astype(np.int64)
        self.lengths = rows.column("length").to_numpy()
        flat = np.concatenate([read_longs(x, 1, k)[0].astype(np.int32) for x, k in zip(rows.column("seq").to_pylist(), self.lengths.tolist())])
        self.got, parts_of = {}, []
        for step, part, size, reply in sorted(zip(*(answers.column(c).to_pylist() for c in ("step", "part", "size", "reply")))):
            self.got.setdefault(step, []).append(read_reply(step, reply, size))
            if step == WORDS:
                parts_of.append(np.full(size, part))
        part = np.concatenate(parts_of) if parts_of else np.zeros(0, np.int64)
        counts, rank = self._answer(WORDS, part)
        number = np.where(counts > 1, FIRST_NUMBER + rank * parts + part, np.where(counts == 1, ONCE, UNSEEN))
        if number.max(initial=0) >= LAST - 1:
            raise ValueError(f"more distinct words than {BITS} bits number")
        order = np.argsort(number)
        order = order[number[order] >= 0]
        self.unigrams = Unigrams(number[order], counts[order], ends, tokens, types)
        # the end and the start are two more words
        stop = np.cumsum(self.lengths)
        self.word = np.insert(np.insert(flat, stop, len(number)), stop - self.lengths + np.arange(len(stop)), len(number) + 1)
        del flat
        self.number, self.count = np.append(number, [END_NUMBER, START_NUMBER]), np.append(counts, [ends, ends])
        self.s = self.number.astype(np.int32)[self.word]
        self.of = np.repeat(np.arange(len(stop), dtype=np.int32), self.lengths + 2)

    def _answer(self, step: int, part: np.ndarray) -> np.ndarray:
        """The answers to a question, in the order of the keys that were asked about."""
        out = np.zeros((REPLIES[step], len(part)), np.int64)
        if len(part):
            out[:, by_part(part, self.parts)] = np.concatenate(self.got.pop(step), axis=1)
        return out

    def _weighed(self, inverse: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(inverse, self.train[self.of[at]], minlength=size).astype(np.int64)

    def find_pairs(self) -> None:
        self.ended = ended_pairs(self.s)
        self.pairs, at = np.unique((self.s[self.ended - 1].astype(np.int64) << BITS) + self.s[self.ended], return_inverse=True)
        self.pair_at = at.astype(np.int32)
        self.pair_part = (mixed(self.pairs, 1) % np.uint64(self.parts)).astype(np.int64)

    def find_triples(self) -> None:
        """3-grams of two kept 2-grams: the first of these, the last word, and how often the later one occurs."""
        self.find_pairs()
        self.pair_n, self.pair_first, self.pair_rank = self._answer(PAIRS, self.pair_part)
        at = np.full(len(self.s), -1, np.int32)
        self.kept = np.flatnonzero(self.pair_n)
        of_kept = np.cumsum(self.pair_n > 0) - 1
        at[self.ended] = np.where(self.pair_n[self.pair_at] > 0, of_kept[self.pair_at], -1)
        self.third = (np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0)) + 1).astype(np.int32)
        del self.ended, self.pair_at
        grams, triple_at = np.unique((at[self.third - 1].astype(np.int64) << BITS) + self.s[self.third], return_inverse=True)
        self.triple_at = triple_at.astype(np.int32)
        self.before, self.last = grams >> BITS, grams & LAST
        self.shorter = np.zeros(len(grams), np.int64)
        self.shorter[self.triple_at] = self.pair_n[self.kept[at[self.third]]]
        self.kept_part = self.pair_part[self.kept]
        self.triple_part = self.kept_part[self.before]

    def _blocks(self, step: int, part: np.ndarray, keys: np.ndarray, *n: np.ndarray) -> list[tuple]:
        laid = {PAIRS: laid_grams, TRIPLES: laid_bytes}.get(step, laid_rising)
        order = by_part(part, self.parts)
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[p]:edges[p + 1]]
            out.append((step, p, self.chunk, len(at), laid(keys[at]), laid_bytes(*(c[at] for c in n))))
        return out

    def ask_pairs(self) -> list[tuple]:
        self.find_pairs()
        return self._blocks(PAIRS, self.pair_part, self.pairs, self._weighed(self.pair_at, self.ended, len(self.pairs)))

    def histories(self) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.unigrams.numbers[1:]
        return numbers, numbers % self.parts

    def ask_triples(self) -> list[tuple]:
        """3-grams in the part of their 2-gram, with all kept 2-grams, and the sums behind histories of one word."""
        self.find_triples()
        numbers, part = self.histories()
        own = np.flatnonzero(self.pair_first)
        at, word, n = places(numbers, self.pairs[own] >> BITS), self.pairs[own] & LAST, self.pair_n[own]
        sums = [np.bincount(at, x, minlength=len(numbers)).astype(np.int64) for x in (np.ones(len(at)), n, self.unigrams.counts(word) + 1)]
        follow = np.bincount(self.before, minlength=len(self.kept))
        return (self._blocks(SINGLES, part, numbers // self.parts, *sums)
                + self._blocks(DOUBLES, self.kept_part, self.pair_rank[self.kept], follow)
                + self._blocks(TRIPLES, self.triple_part, self.last, self._weighed(self.triple_at, self.third, len(self.last)), self.shorter))

    def logs(self) -> np.ndarray:
        """log10 probability of every token, by the automaton."""
        automaton = self._automaton()
        return automaton.traverse(self.s, self.unigrams.logs(self.count)[self.word], automaton.of_word(self.number).astype(np.int32)[self.word])

    def _automaton(self) -> "ChunkAutomaton":
        self.find_triples()
        del self.triple_at, self.third
        n, = self._answer(TRIPLES, self.triple_part)
        third = np.flatnonzero(n)
        numbers, part = self.histories()
        count, mass, below = self._answer(SINGLES, part)
        behind = np.flatnonzero(count)
        words = numbers[behind], left_over((mass - DISCOUNT * count)[behind] / np.maximum(self.unigrams.counts(numbers[behind]), 1),
                                           below[behind] / self.unigrams.total)
        count, mass, below = self._answer(DOUBLES, self.kept_part)
        pairs, counts = self.pairs[self.kept], self.pair_n[self.kept]
        weight = left_over((mass - DISCOUNT * count) / counts, (below - DISCOUNT * count) / np.maximum(self.unigrams.counts(pairs & LAST), 1))
        return ChunkAutomaton(self.unigrams, words, (pairs, counts, np.where(count > 0, weight, np.nan)),
                              (pairs[self.before[third]], self.last[third], n[third]))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written inside leaves no shuffle files behind. A query that is lazily run later isn't concerned."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def blocks_table(blocks: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    cols = zip(*blocks) if blocks else [[]] * 6
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["step", "part", "chunk", "size", "keys", "n"])


def tally(blocks: pa.Table, least: int) -> pa.Table:
    """The questions of all chunks to one part, answered: of words the count and the rank among those seen twice, the most
    frequent first, of 2-grams the count (0: less than ``least``), whether the chunk is the first to ask and the rank among
    those kept, by which the next question names them, of histories the sums over the n-grams behind them, of 3-grams the
    count."""
    kinds = blocks.column("step").to_pylist()
    rows = sorted(zip(kinds, *(blocks.column(c).to_pylist() for c in ("chunk", "size", "keys", "n"))))
    asked = {}
    for step in sorted(set(kinds)):
        own = [r[1:] for r in rows if r[0] == step]
        asked[step] = own, np.concatenate([read_longs(n, ASKED[step], size) for _, size, _, n in own], axis=1)

    def keys_of(step: int) -> np.ndarray:
        read = {PAIRS: read_grams, TRIPLES: read_each}.get(step, read_rising)
        return np.concatenate([read(k, size) for _, size, k, _ in asked[step][0]])

    replies, tokens, types = {}, 0, 0
    if WORDS in asked:
        own, values = asked[WORDS]
        ids: dict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        ends = np.cumsum([r[1] for r in own]).tolist()
        at = np.concatenate([np.array([*map(ids.__getitem__, pa.decompress(
            keys, decompressed_size=int(values[1, z - 1]), codec="zstd", asbytes=True).split())], np.int64) for (_, _, keys, _), z in zip(own, ends)])
        total = np.bincount(at, values[0]).astype(np.int64)
        tokens, types = int(total.sum()), int((total > 0).sum())
        by_word = np.array([*map(ids.__getitem__, sorted(ids))], np.int64)
        by_word = by_word[np.argsort(-total[by_word], kind="stable")]  # the most frequent first: small numbers take few bytes
        rank = np.empty(len(total), np.int64)
        rank[by_word] = np.cumsum(total[by_word] > 1) - 1
        replies[WORDS] = np.stack([total[at], rank[at]])
    if PAIRS in asked:
        _, one, at = np.unique(keys_of(PAIRS), return_index=True, return_inverse=True)
        total = np.bincount(at, asked[PAIRS][1][0]).astype(np.int64)
        first = np.zeros(len(at), np.int64)
        first[one] = 1  # rows are by chunk, and of equal keys ``one`` is the first
        n = np.where(total >= least, total, 0)
        replies[PAIRS] = np.stack([n[at], first * (n[at] > 0), np.cumsum(n > 0)[at]])
    if SINGLES in asked:
        _, at = np.unique(keys_of(SINGLES), return_inverse=True)
        replies[SINGLES] = np.stack([np.bincount(at, v).astype(np.int64)[at] for v in asked[SINGLES][1]])
    if DOUBLES in asked:
        histories, at = np.unique(keys_of(DOUBLES), return_inverse=True)
        sums = [np.zeros(len(histories), np.int64)] * 3
        if TRIPLES in asked:  # chunk by chunk and within it 2-gram by 2-gram, as the 2-grams are
            n, shorter = asked[TRIPLES][1]
            grams, one, triple = np.unique((np.repeat(at, asked[DOUBLES][1][0]) << BITS) + keys_of(TRIPLES), return_index=True, return_inverse=True)
            total = np.bincount(triple, n).astype(np.int64)
            total[total < least] = 0
            replies[TRIPLES] = total[triple][None]
            behind = grams >> BITS
            sums = [np.bincount(behind, x, minlength=len(histories)).astype(np.int64) for x in (total > 0, total, np.where(total > 0, shorter[one], 0))]
        replies[DOUBLES] = np.stack([x[at] for x in sums])
    part, out = blocks.column("part")[0].as_py(), []
    for step, reply in replies.items():
        z = 0
        for chunk, size, _, _ in asked[step][0]:
            out.append((step, part, chunk, size, laid_reply(step, reply[:, z:z + size]), tokens, types))
            tokens = types = 0  # once per part
            z += size
    types_ = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), types_)], names=["step", "part", "chunk", "size", "reply", "tokens", "types"])


class ChunkAutomaton:
    """The part of the automaton that a chunk's texts can reach, as arrays: states, arcs sorted by state and word, and
    failure arcs.

    ``words``: numbers with kept 2-grams behind them, backoff weights; ``pairs``: kept 2-grams, counts, backoff weights
    (NaN: no kept 3-gram goes on from it); ``triples``: 2-gram, last number and count of the kept 3-grams. Words and pairs
    are sorted. State 0 is the root, then come the histories of one word, then those of two."""

    def __init__(self, unigrams: Unigrams, words: tuple, pairs: tuple, triples: tuple):
        self.unigrams, self.numbers = unigrams, words[0]
        grams, counts, weights = pairs
        goes_on = ~np.isnan(weights)
        histories, first = grams[goes_on], 1 + len(self.numbers)
        last = histories & LAST
        self.fail = np.concatenate([np.zeros(first, np.int64), self.of_word(last)])
        self.weight = np.concatenate([[0.0], words[1], weights[goes_on]])
        state = np.where(goes_on, first + np.cumsum(goes_on) - 1, self.of_word(grams & LAST))
        pair, word, n = triples
        at, later = places(histories, pair), places(histories, ((pair & LAST) << BITS) + word)
        arcs = np.concatenate([(self.of_word(grams >> BITS) << BITS) + (grams & LAST), ((first + at) << BITS) + word])
        logs = np.log10(np.concatenate([(counts - DISCOUNT) / np.maximum(unigrams.counts(grams >> BITS), 1),
                                        (n - DISCOUNT) / np.append(counts[goes_on], 1)[at]]))
        to = np.concatenate([state, np.where(later >= 0, first + later, self.of_word(word))])
        order = np.argsort(arcs)
        self.arcs, self.logs, self.to = arcs[order], logs[order], to[order]

    def of_word(self, word: np.ndarray) -> np.ndarray:
        """The state after a word alone."""
        return places(self.numbers, word) + 1

    def step(self, state: np.ndarray, word: np.ndarray, single: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every text reads one word: the states it gets to, and the log10 probabilities. A state without an arc for the
        word follows its failure arc and tries again; the root has an arc for everything, ``single`` and ``after``."""
        state, log, open_ = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(open_):
            own = state[open_]
            root = own == ROOT
            done = open_[root]
            log[done] += single[done]
            state[done] = after[done]
            open_, own = open_[~root], own[~root]
            at = places(self.arcs, (own << BITS) + word[open_])  # words without a number are no arc's
            found = at >= 0
            done, at = open_[found], at[found]
            log[done] += self.logs[at]
            state[done] = self.to[at]
            open_, own = open_[~found], own[~found]
            log[open_] += self.weight[own]
            state[open_] = self.fail[own]
        return state, log

    def traverse(self, s: np.ndarray, single: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 probability of each token of texts in a row, each behind a start (0 for these). ``single``, ``after``: what
        the root's arc for each token says and the state it leads to.

        All texts are read side by side, each left to right with its own state. Long texts are read in stretches that begin
        side by side too: a state knows two words at most, so a stretch gets its state from the two words before it."""
        begin = np.flatnonzero(s == START_NUMBER)
        stop = np.append(begin[1:], len(s))
        parts = -(-(stop - begin - 1) // STRETCH)
        text = np.repeat(np.arange(len(begin)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, end = begin[text] + 1 + part * STRETCH, np.minimum(begin[text] + 1 + (part + 1) * STRETCH, stop[text])
        state = np.zeros(len(at), np.int64)
        inner = part > 0
        state[~inner] = self.of_word(np.full(int((~inner).sum()), START_NUMBER))
        for back in (2, 1):
            here = at[inner] - back
            state[inner] = self.step(state[inner], s[here], single[here], after[here])[0]
        out = np.zeros(len(s))
        order = np.argsort(at - end, kind="stable")  # the longest first, so that those still reading are the first ones
        at, state, length = at[order], state[order], (end - at)[order]
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -k, "left"))
            here = at[:live] + k
            state[:live], out[here] = self.step(state[:live], s[here], single[here], after[here])
        return out


def left_over(kept: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The backoff weight of a history whose arcs have the probabilities ``kept``, and ``below`` without it."""
    return np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - below, 1e-12))


def score(docs: DataFrame, training: Column, text: str = "text", least: int = 2, name: str = "lm",
          keep: list[str] | None = None) -> DataFrame:
    """Add a struct of n_tokens, n_known, train_tokens, base_score and score. Of the own columns only ``keep`` (None:
    all but the text) stay. The chunked texts are cached until ``spark.catalog.clearCache()`` or the session's end."""
    if least < 2:
        raise ValueError("n-grams seen once are not kept: least must be 2 or more")
    spark, own = docs.sparkSession, [c for c in (docs.columns if keep is None else keep) if c != text]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(spark.sparkContext.defaultParallelism, -(-size // CHUNK_BYTES))
    rows = docs.select(*numbered(docs, own), F.coalesce(training, F.lit(False)).alias("train"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    fields = numbered_fields(docs, own)
    schema = T.StructType([
        *fields, T.StructField("train", T.BooleanType()), T.StructField("chunk", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("seq", T.BinaryType()), T.StructField("asked", T.ArrayType(T.StructType.fromDDL(BLOCKS)))])
    texts = (rows.mapInArrow(word_texts(chunks), schema)
             .repartition(chunks, "chunk").persist(StorageLevel.MEMORY_AND_DISK))
    ends = texts.where("train").count()
    seqs = texts.select("chunk", "train", "length", "seq")

    def answered(asked: DataFrame, label: str) -> DataFrame:
        replies = asked.repartition(chunks, "part").groupBy("part").applyInArrow(lambda blocks: tally(blocks, least), ANSWERS)
        with shuffles_freed(spark):
            return stored(replies, label)

    known = answered(texts.where("asked IS NOT NULL").select(F.inline("asked")), "words")
    total = known.agg(F.sum("tokens").alias("n"), F.sum("types").alias("k")).first()
    tokens, types = ends + (total.n or 0), (ends > 0) + (total.k or 0)

    def texts_of(rows: pa.Table, answers: pa.Table) -> Texts:
        return Texts(rows, chunks, answers, ends, tokens, types)

    def asking(question: str):
        return lambda rows, answers: blocks_table(getattr(texts_of(rows, answers), question)())

    for question, label in (("ask_pairs", "pairs"), ("ask_triples", "triples")):
        asked = seqs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(asking(question), BLOCKS)
        known = known.union(answered(asked, label))

    out = T.StructType([*fields, T.StructField("lm", T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]))])

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = texts_of(rows, answers)
        logs, token, size = chunk.logs(), chunk.s != START_NUMBER, rows.num_rows
        base = np.where(token, chunk.unigrams.logs(chunk.count)[chunk.word], 0.0)
        lm = pa.StructArray.from_arrays(
            [pa.array(chunk.lengths + 1), pa.array(np.bincount(chunk.of, token & (chunk.count > 0)[chunk.word], minlength=size).astype(np.int64)),
             pa.array(np.full(size, tokens, np.int64)), pa.array(np.bincount(chunk.of, base, minlength=size)),
             pa.array(np.bincount(chunk.of, logs, minlength=size))],
            names=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return pa.Table.from_arrays([*(rows.column(k) for k in range(len(own))), lm], names=out.names)

    read = texts.select(*(f"c{k}" for k in range(len(own))), "chunk", "train", "length", "seq")
    return read.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(scored, out).toDF(*own, name)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(id_crc(doc_id), F.lit(7)) == 2
