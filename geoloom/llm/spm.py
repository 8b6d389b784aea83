"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding.

Merging works through an agenda: of all adjacent pairs that form a piece the best score goes first, the left one of
ties. Each candidate merge that comes up is skipped if a keyed hash of (seed, document id, unit number, place, piece)
falls below the dropout rate, and comes up again only when one of its two symbols has merged meanwhile. So the same
words are cut in different ways within and across documents, and every run with the same seed gives the same ids.

A unit is a run of characters of which each two neighbours stand next to each other in some piece: no merge can reach
across its ends. Units are counted from the start of their document. Agendas of all units of a batch run side by side
in arrays (``Model._merge``); units of more than 64 characters run one by one (``Model.agenda``), which is the same
procedure in plain Python and what the tests hold the arrays against.

Characters without a piece become UTF-8 byte pieces, as do newlines, NULs and word-start signs that the text itself
holds, and no blank is added or removed: every text decodes to itself.

A null text is empty: no ids. Rows with a null id take the id 0 for the hash. Repeated rows are encoded alike. Other
columns are kept by ``encode``; an existing column ``ids`` is replaced.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import common

SIGN = "▁"
_LONG = 64
_BIG = np.iinfo(np.int32).max
_UNIT, _PLACE, _PIECE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MASK = (1 << 64) - 1
#: Symbols of the agendas that run side by side.
_CELLS = 1 << 19
_MODELS: dict[str, "Model"] = {}


class _Table:
    """Whole numbers by non-negative keys, looked up in arrays; -1 for a key it doesn't hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((1 << bits) + 256, -1, np.int64), np.full((1 << bits) + 256, -1, np.int32)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] += self.keys[at[left]] != -1

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_UNIT)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != -1))
        while len(left):
            at[left] += 1
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out


class Model:
    """A public SentencePiece BPE model file. Symbols are piece ids, then characters that only occur inside pieces, then
    one for all other characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.bytes = np.zeros(256, np.int32)
        self.out: list[bytes] = []
        self.symbols: dict[str, int] = {}
        scores = np.zeros(self.size)
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.symbols[p], scores[i] = i, sp.get_score(i)
                self.out.append(p.replace(SIGN, " ").encode())
        pieces = list(self.symbols.items())
        for p, _ in pieces:
            for c in p:
                self.symbols.setdefault(c, self.size + len(self.symbols) - len(pieces))
        self.other = max(self.symbols.values()) + 1
        self.radix = self.other + 1
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # the best score first
        self.chars = np.full(0x110000, self.other, np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1 and p not in "\0\n":
                self.chars[ord(p)] = i
        self.chars[ord(" ")], self.chars[ord(SIGN)] = self.chars[ord(SIGN)], self.other
        inner = {(self.symbols[a], self.symbols[b]) for p, _ in pieces for a, b in zip(p, p[1:])}
        keys = np.array(sorted(a * self.radix + b for a, b in inner), np.int64)
        self.inner = _Table(keys, np.zeros(len(keys), np.int32))
        pairs = {(self.symbols[p[:k]], self.symbols[p[k:]]): i for p, i in pieces for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols}
        self.pairs = _Table(np.array([a * self.radix + b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))
        self.names = {i: p for p, i in self.symbols.items()}

    @classmethod
    def load(cls, path: str) -> "Model":
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    @staticmethod
    def unit_keys(keys: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
        """The key of each unit, from its document's id and its number there."""
        own = common.mix(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * _PIECE + _PLACE) & _MASK))
        return common.mix(own + numbers.astype(np.uint64) * np.uint64(_UNIT))

    @staticmethod
    def skips(key: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
        """Whether the merge into a piece at a place of a unit is skipped."""
        h = common.mix(key ^ (place.astype(np.uint64) * np.uint64(_PLACE) + piece.astype(np.uint64) * np.uint64(_PIECE)))
        return h < np.uint64(limit)

    def agenda(self, symbols: list[int], key: int, limit: int) -> list[int]:
        """The symbols of a unit after merging, -1 where one has merged into another before it."""
        names, n = [self.names.get(s) for s in symbols], len(symbols)
        symbols = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []
        own = np.array([key], np.uint64)

        def propose(i: int) -> None:
            if after[i] < n and names[i] and names[after[i]]:
                piece = names[i] + names[after[i]]
                at = self.symbols.get(piece)
                if at is not None and at < self.size:
                    heapq.heappush(heap, (int(self.rank[at]), i, piece))

        for i in range(n - 1):
            propose(i)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not names[i] or j >= n or not names[j] or names[i] + names[j] != piece:
                continue  # one of the two has merged meanwhile
            if limit and self.skips(own, np.array([i]), np.array([self.symbols[piece]]), limit)[0]:
                continue
            names[i], names[j], symbols[i], symbols[j] = piece, "", self.symbols[piece], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                propose(i)
            if before[i] >= 0:
                propose(before[i])
        return symbols

    def _merge(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray, width: int, limit: int) -> None:
        """Runs the agendas of units of up to ``width`` symbols side by side and writes their symbols back to flat; rows
        of the arrays are places, columns units."""
        place = np.arange(width, dtype=np.int64)[:, None]
        inside = place < length
        at = np.where(inside, start + place, 0)
        sym = np.where(inside, flat[at], np.int32(self.other))
        pair = np.full(sym.shape, -1, np.int32)
        two = place + 1 < length
        pair[two] = self.pairs.get(sym[two].astype(np.int64) * self.radix + np.roll(sym, -1, 0)[two])
        # the candidate at a place: its rank, then the place
        cost = np.where(pair >= 0, (self.rank[pair] << 6) | place.astype(np.int32), np.int32(_BIG))
        after, before = np.tile(place + 1, len(start)), np.tile(place - 1, len(start))

        def propose(i, j, units):
            """Puts the pairs of the symbols at i and j on the agenda."""
            got = self.pairs.get(sym[i, units].astype(np.int64) * self.radix + sym[j, units])
            pair[i, units] = got
            cost[i, units] = np.where(got >= 0, (self.rank[got] << 6) | i.astype(np.int32), np.int32(_BIG))

        while True:
            best = cost.min(0)
            units = np.flatnonzero(best < _BIG)
            if not len(units):
                break
            i = (best[units] & 63).astype(np.int64)
            piece = pair[i, units]
            cost[i, units] = _BIG
            if limit:
                go = ~self.skips(key[units], i, piece, limit)
                i, units, piece = i[go], units[go], piece[go]
            j = after[i, units]
            sym[i, units], sym[j, units], cost[j, units] = piece, -1, _BIG
            k = after[j, units]
            after[i, units] = k
            more = k < length[units]
            before[k[more], units[more]] = i[more]
            propose(i[more], k[more], units[more])
            h = before[i, units]
            more = h >= 0
            propose(h[more], i[more], units[more])
            if 4 * len(units) < cost.shape[1] and cost.shape[1] > 64:  # most are through: go on with the rest
                left = cost.min(0) < _BIG
                flat[at[:, ~left][inside[:, ~left]]] = sym[:, ~left][inside[:, ~left]]
                at, inside, sym, pair, cost, after, before = (np.ascontiguousarray(x[:, left]) for x in (at, inside, sym, pair, cost, after, before))
                length, key = length[left], key[left]
        flat[at[inside]] = sym[inside]

    def encode(self, texts: list[str], keys: list[int], dropout: float, seed: int) -> list[np.ndarray]:
        """Ids of each text; keys are the documents' ids."""
        limit = min(_MASK, int(dropout * 2.0**64))
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        flat = self.chars[points]
        opens = np.ones(n, bool)
        if n:
            opens[1:] = self.inner.get(flat[:-1].astype(np.int64) * self.radix + flat[1:]) < 0
            opens[first[:-1][first[:-1] < n]] = True
        start = np.flatnonzero(opens)
        length = np.diff(start, append=n)
        doc = np.searchsorted(first, start, "right") - 1
        number = np.arange(len(start)) - np.searchsorted(start, first[:-1])[doc]
        key = self.unit_keys(np.array(keys, np.int64)[doc] if n else np.zeros(0, np.int64), number, seed)
        low = 1
        for width in (4, 8, 16, 32, _LONG):
            own = np.flatnonzero((length > low) & (length <= width))
            for k in range(0, len(own), _CELLS // width):
                part = own[k : k + _CELLS // width]
                self._merge(flat, start[part], length[part], key[part], width, limit)
            low = width
        for u in np.flatnonzero(length > _LONG):
            a, b = start[u], start[u] + length[u]
            flat[a:b] = self.agenda(flat[a:b].tolist(), int(key[u]), limit)
        # characters without a piece of their own become bytes
        spelt = np.flatnonzero(flat >= self.size)
        code = points[spelt]
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        count = (flat >= 0).astype(np.int64)
        count[spelt] = size
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        ids = np.empty(ends[-1], np.int32)
        plain = np.flatnonzero((flat >= 0) & (flat < self.size))
        ids[ends[plain]] = flat[plain]
        for length_ in range(1, 5):
            own = size == length_
            at, c = ends[spelt[own]], code[own]
            lead = c >> (6 * (length_ - 1)) | (0, 0, 0xC0, 0xE0, 0xF0)[length_]
            for k in range(length_):
                ids[at + k] = self.bytes[lead if k == 0 else c >> (6 * (length_ - 1 - k)) & 0x3F | 0x80]
        return np.split(ids, ends[first[1:-1]]) if len(texts) else []

    def decode(self, ids) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column ids (array<int>)."""
    kept = [c for c in docs.columns if c != "ids"]
    at_id, at_text = kept.index(id_col), kept.index(text_col)
    rows = common.plain(docs.select(*common.cols(kept)))
    schema = StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        model = Model.load(model_path)
        for batch in common.small(batches):
            texts = [t or "" for t in batch.column(at_text).cast(pa.string()).to_pylist()]
            keys = [k or 0 for k in batch.column(at_id).to_pylist()]
            ids = [x for at, part in common.chunks(texts, common.CHUNK_CHARS) for x in model.encode(part, keys[at : at + len(part)], dropout, seed)]
            ends = np.cumsum([0, *map(len, ids)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "ids"])

    return common.map_arrow(rows, run, schema).toDF(*kept, "ids")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """id and the decoded text of rows with a column ids."""

    def run(batches):
        model = Model.load(model_path)
        for batch in common.small(batches):
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array([model.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], [id_col, "text"])

    return common.map_arrow(rows.select(id_col, "ids"), run, f"{id_col} bigint, text string")


def round_trip(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), text_sha256 of the text decoded from
    the ids, lossless (whether that text is the document's)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import hashlib

        model = Model.load(model_path)
        for batch in common.small(batches):
            docs, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            got = []
            for at, part in common.chunks(texts, common.CHUNK_CHARS):
                for i, (t, ids) in enumerate(zip(part, model.encode(part, [k or 0 for k in docs[at : at + len(part)]], dropout, seed)), at):
                    back = model.decode(ids.tolist())
                    got.append((docs[i], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got) if got else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["doc_id", "n_tokens", "ids_crc32", "text_sha256", "lossless"])

    return common.map_arrow(rows, run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_sha256 string, lossless boolean")
