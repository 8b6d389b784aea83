"""Tile caches: an in-memory LRU with a time to live, and sweeps of a stored cache's index."""

from __future__ import annotations

import os
import re
import tempfile
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Lru:
    """Keeps the most recently used entries; entries older than ttl seconds are gone. Capacity 0 keeps nothing."""

    def __init__(self, capacity: int, ttl: float = 0.0, clock=time.monotonic):
        self.capacity, self.ttl, self.clock, self._rows = capacity, ttl, clock, OrderedDict()

    def __len__(self) -> int:
        return len(self._rows)

    def get(self, key: str):
        got = self._rows.get(key)
        if got is None:
            return None
        if self.ttl > 0 and self.clock() - got[1] > self.ttl:
            del self._rows[key]
            return None
        self._rows.move_to_end(key)
        return got[0]

    def set(self, key: str, value) -> None:
        if self.capacity <= 0:
            return
        self._rows[key] = (value, self.clock())
        self._rows.move_to_end(key)
        while len(self._rows) > self.capacity:
            self._rows.popitem(last=False)


_SEGMENT = re.compile(r"[A-Za-z0-9_.-]+")


class Disk:
    """Files below a folder by key (layer/z/x/y), for one machine; a shared store of whole pyramids is tiles.write_store.
    Entries older than ttl seconds are gone; ``sweep`` also keeps the folder within its size. Keys with odd segments
    aren't kept."""

    def __init__(self, folder: str, ttl: float = 0.0, max_bytes: int = 0, clock=time.time):
        self.folder, self.ttl, self.max_bytes, self.clock = folder, ttl, max_bytes, clock
        os.makedirs(folder, exist_ok=True)

    def _path(self, key: str) -> str | None:
        parts = key.split("/")
        if any(p in (".", "..") or not _SEGMENT.fullmatch(p) for p in parts):
            return None
        return os.path.join(self.folder, *parts)

    def _old(self, mtime: float) -> bool:
        return self.ttl > 0 and self.clock() - mtime > self.ttl

    def get(self, key: str) -> bytes | None:
        path = self._path(key)
        try:
            if path is None or self._old(os.stat(path).st_mtime):
                if path is not None:
                    os.remove(path)
                return None
            with open(path, "rb") as f:
                return f.read()
        except OSError:  # not there, or gone meanwhile
            return None

    def set(self, key: str, value: bytes) -> None:
        """Writes under another name first, so that no reader sees half a file."""
        path = self._path(key)
        if path is None:
            return
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, name = tempfile.mkstemp(prefix=".tmp-", dir=os.path.dirname(path))
        with os.fdopen(handle, "wb") as f:
            f.write(value)
        os.replace(name, path)

    def entries(self) -> list[tuple[str, int, float]]:
        """(path, size, mtime) of all files."""
        out = []
        for folder, _, names in os.walk(self.folder):
            for name in names:
                try:
                    got = os.stat(path := os.path.join(folder, name))
                    out.append((path, got.st_size, got.st_mtime))
                except OSError:
                    continue
        return out

    def sweep(self) -> int:
        """Removes old entries, leftovers of writers that died an hour ago or more, and then the oldest entries until nine
        tenths of the size are used; returns how many files went. A caller runs it every few minutes."""
        gone, kept = [], []
        for path, size, mtime in self.entries():
            left_over = os.path.basename(path).startswith(".tmp-")
            if left_over and self.clock() - mtime > 3600 or not left_over and self._old(mtime):
                gone.append(path)
            elif not left_over:
                kept.append((mtime, path, size))
        total = sum(size for _, _, size in kept)
        if 0 < self.max_bytes < total:
            for _, path, size in sorted(kept):
                if total <= self.max_bytes * 9 // 10:
                    break
                gone.append(path)
                total -= size
        for path in gone:
            try:
                os.remove(path)
            except OSError:
                continue
        return len(gone)


class Tiered:
    """A small fast cache over a large one; what the large one has moves up when it is asked for."""

    def __init__(self, upper, lower):
        self.upper, self.lower = upper, lower

    def get(self, key: str):
        got = self.upper.get(key)
        if got is None and (got := self.lower.get(key)) is not None:
            self.upper.set(key, got)
        return got

    def set(self, key: str, value) -> None:
        self.upper.set(key, value)
        self.lower.set(key, value)


def sweep(entries: DataFrame, now, ttl_s: float, max_bytes: int) -> DataFrame:
    """entries (key, size, mtime in seconds) that stay: none older than ttl_s; if the others exceed max_bytes, the oldest go
    until at most nine tenths of it are left. Times of equal age go by key. Sizes are first summed by whole seconds, so
    that only the sums need one order; the second on the edge is then ranked alone."""
    alive = entries.where(F.lit(now) - F.col("mtime") <= ttl_s) if ttl_s > 0 else entries
    target = max_bytes * 9 // 10
    # newest seconds first: bytes that are as new or newer
    by_second = alive.groupBy("mtime").agg(F.sum("size").alias("bytes"))
    newer = F.coalesce(F.sum("bytes").over(Window.orderBy(F.desc("mtime")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_second = by_second.withColumn("newer", newer)
    total = alive.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    rows = alive.join(by_second.select("mtime", "newer"), "mtime").crossJoin(F.broadcast(total))
    within = F.sum("size").over(Window.partitionBy("mtime").orderBy(F.desc("key")))
    rows = rows.withColumn("kept", F.col("newer") + within)
    return rows.where((F.lit(max_bytes) <= 0) | (F.col("total") <= max_bytes) | (F.col("kept") <= target)).select("key", "size", "mtime")
