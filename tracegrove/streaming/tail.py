"""A streaming source that tails a growing, rotating log file by inode and byte offset."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def siblings(path: str, most: int) -> list[tuple[int, str]]:
    """inode and name of the log's files that are there, rotated ones first, the oldest of them foremost."""
    out = []
    for name in [*(f"{path}.{k}" for k in range(most, 0, -1)), path]:
        try:
            out.append((os.stat(name).st_ino, name))
        except FileNotFoundError:
            continue
    return out


def whole_lines(path: str, start: int, most: int = 1 << 62) -> tuple[list[str], int, bool]:
    """Complete lines from a byte offset on, of about ``most`` bytes or one line, the offset behind them, and whether the file ends there.

    A partial last line waits.
    """
    data, more = b"", False
    try:
        with open(path, "rb") as f:
            f.seek(start)
            while part := f.read(min(max(most - len(data), 1 << 16), 1 << 24)):
                data += part
                if more := len(data) >= most and b"\n" in data:
                    break
    except FileNotFoundError:
        return [], start, True
    cut = data.rfind(b"\n") + 1
    return _lines(data[:cut]), start + cut, not more


def _lines(data: bytes) -> list[str]:
    return [x.decode("utf-8", "replace") for x in data.split(b"\n")[:-1] if x.strip()]


class TailReader(SimpleDataSourceStreamReader):
    """Offsets are {inode, pos, parts}; after a rotation the rest of the old file comes first, oldest to newest.

    ``parts`` are the byte ranges (inode, from, to) that lead to the offset from the one before. A batch that is run again reads
    just those, whatever has been appended or renamed since; it fails if a file of them is gone. A batch takes about
    ``batch`` bytes, so that the driver never holds a whole log.
    """

    def __init__(self, path: str, most: int, batch: int = 64 << 20):
        self.path, self.most, self.batch = path, most, batch

    def initialOffset(self) -> dict:  # noqa: N802
        return {"inode": 0, "pos": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        files = siblings(self.path, self.most)
        if not files:
            return iter(()), start
        inode, pos = start["inode"], start["pos"]
        known = [i for i, _ in files]
        # a file that has been rotated away for good leaves the current one only
        files = files[known.index(inode) :] if inode in known else files if not inode else files[-1:]
        if files[0][0] != inode or os.path.getsize(files[0][1]) < pos:  # another file, or truncated in place
            pos = 0
        lines: list[str] = []
        parts: list[list[int]] = []
        left = self.batch
        for k, (inode, name) in enumerate(files):
            got, to, ended = whole_lines(name, pos, left)
            lines += got
            if to > pos:
                parts.append([inode, pos, to])
            left -= to - pos
            pos = to
            if not ended or left <= 0 or k == len(files) - 1:
                break
            pos = 0
        if not parts and inode == start["inode"] and pos == start["pos"]:
            return iter(()), start
        return iter([(x,) for x in lines]), {"inode": inode, "pos": pos, "parts": parts}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:  # noqa: N802
        files = dict(siblings(self.path, self.most))
        for inode, begin, to in end.get("parts", []):
            if inode not in files:
                raise FileNotFoundError(f"{self.path}: the file of inode {inode} is gone, bytes {begin} to {to} can't be read again")
            with open(files[inode], "rb") as f:
                f.seek(begin)
                yield from ((x,) for x in _lines(f.read(to - begin)))

    def commit(self, end: dict) -> None:
        return None


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", ...)``: one string column, ``value``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> TailReader:  # noqa: ANN001, N802
        return TailReader(self.options["path"], int(self.options.get("rotations", 5)), int(self.options.get("batchBytes", 64 << 20)))
