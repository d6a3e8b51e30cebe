r"""JSON files that hold one large array (or an object of arrays), read in pieces of bytes by many tasks.

A cut may fall anywhere, within a string or after a backslash. Each piece is therefore summed up first for both cases, that it begins outside
or inside a string: whether its quotes are odd in number, and how far its brackets rise or fall. The sums of the pieces before give a piece
its true state, one small row for each piece. Then each piece finds the records that begin in it, by depth, and reads on to the
end of the last one. Records come as JSON text and are parsed by ``from_json``, whose schema prunes what is not asked for.

Whether a quote is escaped is told by the backslashes before it, which are looked up beyond the piece's begin. Files are read through
Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece.
PIECE = 32 << 20
_OPEN, _CLOSE, _QUOTE, _BACKSLASH = (ord("{"), ord("[")), (ord("}"), ord("]")), ord('"'), ord("\\")


def _open(path: str):
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    fs, place = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(place)


def _escaped_at(file, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    n = 0
    while start > n:
        back = min(64, start - n)
        tail = file.read_at(back, start - n - back)
        run = len(tail) - len(tail.rstrip(b"\\"))
        n += run
        if run < back:
            break
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that are not escaped."""
    slash = np.r_[data == _BACKSLASH]
    places = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, places)) if len(data) else places
    before = np.r_[-1, last_other[:-1]] if len(data) else last_other  # the last byte before that is no backslash
    run = places - 1 - before
    odd = (run + ((before == -1) & escaped)) % 2 == 1
    return np.flatnonzero((data == _QUOTE) & ~odd)


def _levels(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and +1 or -1 for each."""
    at = np.flatnonzero(np.isin(data, [*_OPEN, *_CLOSE]))
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, np.where(np.isin(data[at], _OPEN), 1, -1)


def _sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path, start, size in zip(part["path"], part["start"], part["size"], strict=True):
            with _open(path) as file:
                data, escaped = np.frombuffer(file.read_at(size, start), np.uint8), _escaped_at(file, start)
            quotes = _quotes(data, escaped)
            rise = [int(_levels(data, quotes, inside)[1].sum()) for inside in (False, True)]
            rows.append((path, start, size, len(quotes) % 2, *rise))
        yield pd.DataFrame(rows, columns=["path", "start", "size", "odd", "rise_outside", "rise_inside"])


class _Records:
    """The records of a piece whose state at its begin is known."""

    def __init__(self, path: str, start: int, size: int, inside: bool, depth: int, level: int) -> None:
        self.path, self.start, self.size, self.inside, self.depth, self.level = path, start, size, inside, depth, level

    def rows(self) -> Iterator[tuple[int, str, str]]:
        """(offset, kind, text): records, and for objects of arrays the name of each array where it begins."""
        with _open(self.path) as file:
            escaped = _escaped_at(file, self.start)
            data = file.read_at(self.size, self.start)
            length = file.size()
            while True:
                raw = np.frombuffer(data, np.uint8)
                at, step = _levels(raw, _quotes(raw, escaped), self.inside)
                depth = self.depth + np.cumsum(step)
                begins = (step == 1) & (depth == self.level + 1) & (raw[at] == _OPEN[0]) & (at < self.size)
                ends = at[(step == -1) & (depth == self.level)]
                first = at[begins]
                stop = np.searchsorted(ends, first)
                if not len(stop) or stop[-1] < len(ends) or self.start + len(data) >= length:
                    break
                data += file.read_at(max(1 << 16, len(data)), self.start + len(data))  # the last record goes on
            for a, k in zip(first.tolist(), stop.tolist(), strict=True):
                if k < len(ends):
                    yield self.start + a, "record", data[a : int(ends[k]) + 1].decode()
            if self.level == 2:
                arrays = at[(step == 1) & (depth == 2) & (raw[at] == _OPEN[1]) & (at < self.size)]
                for a in arrays.tolist():
                    back = max(0, self.start + a - 4096)
                    name = file.read_at(self.start + a - back, back).rstrip().removesuffix(b":").rstrip().removesuffix(b'"')
                    yield self.start + a, "array", name[name.rfind(b'"') + 1 :].decode()


def _parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for x in part.itertuples(index=False):
            rows = list(_Records(x.path, x.start, x.size, bool(x.inside), x.depth, x.level).rows())
            for k in range(0, len(rows), 10_000):
                some = rows[k : k + 10_000]
                yield pd.DataFrame({"path": [x.path] * len(some), "offset": [r[0] for r in some], "kind": [r[1] for r in some], "value": [r[2] for r in some]})


def json_records(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(path, offset, array, value): the objects of each file's array, or of the arrays of each file's object (``array`` is the name, else null)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    pieces = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {piece}L)")).alias("start"), "length")
    pieces = pieces.selectExpr("path", "start", f"least({piece}L, length - start) AS size")
    most = 8 * spark.sparkContext.defaultParallelism
    dealt = lambda df: df.repartition(max(1, min(df.count(), most)), "path", "start")  # noqa: E731  a task works off its pieces one by one
    sums = dealt(pieces).mapInPandas(_sums, "path string, start long, size long, odd int, rise_outside int, rise_inside int")
    known, state = [], {}
    for x in sums.orderBy("path", "start").toLocalIterator():  # a row for each piece
        inside, depth, root = state.get(x.path, (0, 0, None))
        if root is None:
            with _open(x.path) as file:
                head = file.read_at(min(1 << 16, x.size), 0).lstrip(b"\xef\xbb\xbf \t\r\n")
            root = 1 if head[:1] == b"[" else 2
        known.append((x.path, x.start, x.size, inside, depth, root))
        state[x.path] = (inside ^ x.odd, depth + (x.rise_inside if inside else x.rise_outside), root)
    schema = "path string, start long, size long, inside int, depth int, level int"
    if not known:
        return spark.createDataFrame([], "path string, offset long, array string, value string")
    rows = dealt(spark.createDataFrame(known, schema)).mapInPandas(_parse, "path string, offset long, kind string, value string")
    if all(k[5] == 1 for k in known):
        return rows.select("path", "offset", F.lit(None).cast("string").alias("array"), "value")
    arrays = rows.where("kind = 'array'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "value")), asc=False).alias("arrays"))  # a few for each file
    named = rows.where("kind = 'record'").join(F.broadcast(arrays), "path", "left")
    return named.select("path", "offset", F.expr("element_at(filter(arrays, a -> a.offset < offset), 1).value").alias("array"), "value")
