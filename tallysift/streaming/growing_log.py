"""Log files that are still being written, as a streaming source of complete lines.

The offset of a batch is a map from file to the byte after its last complete line, so a file may
grow between two batches, and a half-written last line waits for its end. A batch's share of a file
is cut into pieces, each a task; a line belongs to the piece that it starts in.
"""

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL_BYTES = 1 << 16
PIECE_BYTES = 64 << 20


@dataclass
class Piece(InputPartition):
    """Bytes ``start`` to ``stop`` of a file; ``first``: the batch's share begins here; ``end``: and ends there."""

    path: str
    start: int
    stop: int
    first: bool
    end: int


def complete_bytes(f, known: int) -> int:
    """Bytes up to and with the last line end, looking no further back than ``known``."""
    at = f.size()
    while at > known:
        begin = max(known, at - TAIL_BYTES)
        f.seek(begin)
        found = f.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return known


class GrowingLines(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.piece = options["path"], int(options.get("piece_bytes", PIECE_BYTES))
        self.known: dict[str, int] = {}

    def _store(self):
        return fs.FileSystem.from_uri(self.root)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, path = self._store()
        out = {}
        for f in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if f.is_file and not f.base_name.startswith((".", "_")):
                known = self.known.get(f.path, 0)
                if f.size > known:
                    with store.open_input_file(f.path) as opened:
                        known = complete_bytes(opened, known)
                out[f.path] = known
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            cuts = [*range(begin, stop, self.piece), stop]
            out += [Piece(path, a, b, a == begin, stop) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: Piece):
        store, _ = self._store()
        with store.open_input_file(partition.path) as f:
            at = partition.start - (not partition.first)
            f.seek(at)
            held, skip = b"", not partition.first
            while at < partition.end:
                data = f.read(min(1 << 20, partition.end - at))
                begin = at - len(held)
                at += len(data)
                *lines, rest = (held + data).split(b"\n")
                for line in lines:
                    if not skip:
                        if begin >= partition.stop:
                            return
                        yield partition.path, line.rstrip(b"\r").decode("utf-8", "replace")
                    skip = False
                    begin += len(line) + 1
                held = rest


class GrowingLog(DataSource):
    """Format ``growing_log``: columns file and line. Options: path, piece_bytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "file string, line string"

    def streamReader(self, schema) -> GrowingLines:
        return GrowingLines(self.options)


def read_growing(spark: SparkSession, path: str):
    """Stream of (file, line) below ``path``."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").load(path)
