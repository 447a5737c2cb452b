"""Large JSON arrays of records, read by many tasks each.

Where a record begins can't be told from the middle of a file: a brace may be text. So a file is read twice in pieces. First
each piece notes, for both cases (its first byte inside a string or not), how it changes the nesting and how many braces it
opens at which level; a line of such notes says for every piece whether it begins inside a string, how deep, and after how
many records. Then each piece yields the records that begin in it, reading on past its end for the last one.

A task holds a megabyte of text and one record. Broken arrays are errors, wherever they break.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 32 << 20
READ_BYTES = 1 << 20
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[[ord(c) for c in "{}[]"]] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


@dataclass
class Walker:
    """Follows strings and nesting through consecutive stretches of a text."""

    depth: int = 0
    inside: bool = False  # in a string
    escaped: bool = False  # the next byte follows an open backslash

    def feed(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the brackets outside strings, the brackets, and the depth before each."""
        data = np.frombuffer(raw, np.uint8)
        quotes = np.flatnonzero(data == 34)
        slashes = np.flatnonzero(data == 92)
        open_, self.escaped = self.escaped, False
        if len(slashes) or open_:
            skipped = []
            if open_ and len(data):
                skipped.append(0)
                slashes = slashes[slashes != 0]
            if len(slashes):
                first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
                length = np.diff(np.append(first, len(slashes)))
                after = slashes[first] + length
                odd = after[length % 2 == 1]
                self.escaped = bool(len(odd)) and int(odd[-1]) == len(data)
                skipped += odd[odd < len(data)].tolist()
            quotes = quotes[~np.isin(quotes, skipped)]
        at = np.flatnonzero(_STRUCTURE[data])
        within = (np.searchsorted(quotes, at) + self.inside) % 2 == 1
        at = at[~within]
        kind = data[at]
        steps = _STEP[kind]
        before = self.depth + np.cumsum(steps) - steps
        self.depth += int(steps.sum())
        self.inside = bool((len(quotes) + self.inside) % 2)
        return at, kind, before


@dataclass
class Note:
    """What a piece does to the state, for one case of how it begins."""

    change: int = 0
    inside: bool = False
    opened: Counter = field(default_factory=Counter)  # braces opened, by depth relative to the piece's beginning


def _open(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def _starts_escaped(f, start: int) -> bool:
    """Whether an odd number of backslashes stands before ``start``."""
    count, at = 0, start
    while at:
        begin = max(0, at - 64)
        f.seek(begin)
        raw = f.read(at - begin)
        run = len(raw) - len(raw.rstrip(b"\\"))
        count += run
        if run < len(raw):
            break
        at = begin
    return count % 2 == 1


def _stretches(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    while start < stop:
        f.seek(start)
        raw = f.read(min(READ_BYTES, stop - start))
        if not raw:
            return
        yield start, raw
        start += len(raw)


def note_piece(path: str, start: int, stop: int) -> tuple[Note, Note]:
    out = []
    with _open(path) as f:
        escaped = _starts_escaped(f, start)
        for inside in (False, True):
            walker, note = Walker(0, inside, escaped), Note()
            for _, raw in _stretches(f, start, stop):
                _, kind, before = walker.feed(raw)
                note.opened.update(before[kind == 123].tolist())
            note.change, note.inside = walker.depth, walker.inside
            out.append(note)
    return tuple(out)


def piece_records(path: str, start: int, stop: int, size: int, depth: int, inside: bool) -> Iterator[bytes]:
    """The records that begin in the piece. What lies between records is checked up to the next record's brace."""
    def check(good: bool) -> None:
        if not good:
            raise ValueError(f"{path}: not a whole array of records")

    with _open(path) as f:
        walker = Walker(depth, inside, _starts_escaped(f, start))
        # gap: what came since the last record of this piece, or since the file's begin; held: the open record
        lead, gap, held = start == 0, b"" if start == 0 else None, None
        for at, raw in _stretches(f, start, size):
            places, kind, before = walker.feed(raw)
            done = 0
            top = ((kind == 123) & (before == 1)) | ((kind == 125) & (before == 2))
            for p, k in zip(places[top].tolist(), kind[top].tolist()):
                if k == 123:
                    check(gap is None or _blankless(gap + raw[done:p]) == (b"[" if lead else b","))
                    if at + p >= stop:
                        return
                    lead, gap, held, done = False, None, [], p
                elif held is not None:
                    yield b"".join([*held, raw[done:p + 1]])
                    gap, held, done = b"", None, p + 1
            if held is not None:
                held.append(raw[done:])
            elif gap is not None:
                gap = _blankless(gap + raw[done:])
                check(len(gap) <= 2)
            elif at + len(raw) >= stop:
                return
        check(held is None)
        check(gap is None or _blankless(gap) in ((b"", b"[]") if lead else (b"]",)))


def _blankless(text: bytes) -> bytes:
    return b"".join(text.split())


def read_array_records(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, pos, value): each record of the arrays at ``path`` (globs too) as text, numbered from 0 in its file."""
    # a line for a piece is short, the piece is not: by a number of tasks, so that they aren't put together
    tasks = 2 * spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(piece_bytes).cast("long"))
    pieces = files.select("path", "length", F.explode(cuts).alias("start")).withColumn(
        "stop", F.least("length", F.col("start") + piece_bytes)).repartition(tasks)

    def notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                # a piece that is its file needs no note
                alone = row["start"] == 0 and row["stop"] == row["length"]
                pair = (Note(), Note()) if alone else note_piece(row["path"], row["start"], row["stop"])
                opened = [[{"depth": d, "n": n} for d, n in note.opened.items()] for note in pair]
                yield pa.RecordBatch.from_pylist([{
                    **row, "change": [note.change for note in pair], "inside": [note.inside for note in pair],
                    "opened": opened}], schema=_arrow_notes())

    noted = pieces.mapInArrow(notes, "path string, length long, start long, stop long, change array<long>, "
                                     "inside array<boolean>, opened array<array<struct<depth: long, n: long>>>")

    def states(table: pa.Table) -> pa.Table:
        """One file's notes in order to the state in which each piece begins; a file has few pieces."""
        depth, inside, records, out = 0, False, 0, []
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        for r in rows:
            out.append({"path": r["path"], "length": r["length"], "start": r["start"], "stop": r["stop"], "depth": depth,
                        "inside": inside, "records": records})
            records += sum(o["n"] for o in r["opened"][inside] if o["depth"] + depth == 1)
            depth, inside = depth + r["change"][inside], r["inside"][inside]
        if depth or inside:
            raise ValueError(f"{rows[0]['path']}: the array is broken off")
        return pa.Table.from_pylist(out, schema=_arrow_states())

    known = noted.groupBy("path").applyInArrow(
        states, "path string, length long, start long, stop long, depth long, inside boolean, records long")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found, held, size = r["records"], [], 0
                for value in piece_records(r["path"], r["start"], r["stop"], r["length"], r["depth"], r["inside"]):
                    held.append(value)
                    size += len(value)
                    if size >= READ_BYTES:
                        yield _text_rows(r["path"], found, held)
                        found, held, size = found + len(held), [], 0
                if held:
                    yield _text_rows(r["path"], found, held)

    return known.repartition(tasks).mapInArrow(records, "path string, pos long, value string")


def _text_rows(path: str, first: int, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(values)), pa.array(range(first, first + len(values)), pa.int64()),
         pa.array([v.decode("utf-8", "replace") for v in values])], names=["path", "pos", "value"])


def _arrow_notes() -> pa.Schema:
    counts = pa.list_(pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))
    return pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                      ("change", pa.list_(pa.int64())), ("inside", pa.list_(pa.bool_())), ("opened", counts)])


def _arrow_states() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                      ("depth", pa.int64()), ("inside", pa.bool_()), ("records", pa.int64())])
