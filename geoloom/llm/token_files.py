"""Token ids in Arrow IPC files of equal-length sequences.

A file's batches hold fixed-size lists: ``ids`` (sequence_length unsigned ints) and ``mask`` (booleans, false on the
padding of the file's last sequence). Every batch but the last has the same number of sequences, so that token t of a
file is found by arithmetic in memory-mapped batches, without a copy. Documents follow one another in ascending
order of id, each closed by the end id; ranges of ids are the files, and a second file beside each (``.index``) gives
every document's first token and length.

Tasks write under a name of their own and rename the whole file, so that a retried task leaves no half-written one;
only files named in the manifest count.

A null text is empty and yields the end id alone. Rows with a null id are left out; repeated ids are written each, in
order of a hash of their texts. Special tokens spelt in a text follow the tokenizers library's default. Other columns are
dropped.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE = 1024
BATCH = 64  # sequences a batch
END_ID = 2
#: Bytes of words, stems and their ids that a worker keeps in each of two generations, about. They stay from task to task.
CACHE_BYTES = 160 << 20
_ENTRY = 180  # bytes of an entry besides its text and ids
_JOINED = 500
_TAIL = ".,;:!?*%$&#"
INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
_CACHE: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Encodes texts as ``encode(text, add_special_tokens=False)`` of the tokenizers library does.

    The vocabulary's normaliser composes (NFC), turns white space into blanks and lowers; its pattern never joins what
    blanks separate. A blank neither composes with its neighbours nor lowers anything across itself, so a text's ids are
    those of its words between ASCII blanks one after another, and a word that came up before is looked up. Words whose
    characters all lie below U+0130 are taken apart further: there normalising is lowering, character by character and
    letter to letter, so the pattern always cuts between a letter or number and a sign of ``_TAIL`` after it, and the
    stem may be looked up in lower case. All other words go through the library as they are. Texts that hold a special
    token's string go through the library whole. Another vocabulary must have the same normaliser and pattern, which
    the constructor checks; else every text goes through the library whole."""

    def __init__(self, path: str, width: str):
        import json

        from tokenizers import Tokenizer

        self.width = width
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        pattern = split[0]["pattern"].get("Regex", "") if split else ""
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and split[0].get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.size, self.words, self.stems, self.words_before, self.stems_before = 0, {"": b""}, {"": b""}, {}, {}

    @classmethod
    def load(cls, path: str, width: str) -> "Encoder":
        if (path, width) not in _CACHE:
            _CACHE[path, width] = cls(path, width)
        return _CACHE[path, width]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        if max(word) >= "\u0130":
            return word, ""
        stem = word.rstrip(_TAIL)
        if not stem or len(stem) < len(word) and not stem[-1].isalnum():
            return word, ""
        return stem.lower(), word[len(stem) :]

    def _learn(self, fresh: list[str]) -> None:
        parts = [self._parts(w) for w in fresh]
        stems = self.stems
        new = []
        for x in dict.fromkeys(x for pair in parts for x in pair):
            if x not in stems:
                got = self.stems_before.get(x)
                if got is None:
                    new.append(x)
                else:
                    stems[x] = got
                    self.size += _ENTRY + 2 * len(x) + len(got)
        plain = [x for x in new if "|" not in x] if self.bar is not None else []
        for at in range(0, len(plain), _JOINED):
            # one call for many of them, kept apart by a sign between blanks that none of them holds
            part = plain[at : at + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" | ".join(part)], add_special_tokens=False)[0].ids, self.width)
            cuts = np.flatnonzero(ids == self.bar)
            raw, size = ids.tobytes(), ids.itemsize
            for x, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                stems[x] = raw[a * size : b * size]
        for x in new:
            if x not in stems:
                stems[x] = self._bytes(self.tokenizer.encode(x, add_special_tokens=False).ids)
            self.size += _ENTRY + 2 * len(x) + len(stems[x])
        for w, (stem, tail) in zip(fresh, parts):
            got = self.words[w] = stems[stem] + stems[tail]
            self.size += _ENTRY + 2 * len(w) + len(got)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned integers of the chosen width."""
        if not self.by_words:
            return [self._whole(x) for x in texts]
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        if self.size > CACHE_BYTES:
            self.words_before, self.words, self.stems_before, self.stems, self.size = self.words, {"": b""}, self.stems, {"": b""}, 0
        words, before, fresh = self.words, self.words_before, []
        for w in {w for s in split for w in s}:
            if w not in words:
                got = before.get(w)
                if got is None:
                    fresh.append(w)
                else:
                    words[w] = got
                    self.size += _ENTRY + 2 * len(w) + len(got)
        self._learn(fresh)
        get = words.__getitem__
        return [self._whole(x) if any(y in x for y in self.special) else b"".join(map(get, s)) for x, s in zip(texts, split)]


class _Writer:
    """Collects tokens and writes whole batches of sequences."""

    def __init__(self, sink, length: int, width: pa.DataType):
        self.length, self.held, self.size, self.total = length, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * BATCH:
            self._write(self.size // (self.length * BATCH) * BATCH)

    def _write(self, sequences: int) -> None:
        flat = np.concatenate(self.held)
        real = min(len(flat), sequences * self.length)
        for a in range(0, sequences, BATCH):
            part = flat[a * self.length : (a + BATCH) * self.length]
            n = min(BATCH, sequences - a)
            mask = np.zeros(n * self.length, bool)
            mask[: len(part)] = True
            part = np.concatenate([part, np.zeros(n * self.length - len(part), part.dtype)])
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.size = ([flat[real:]], len(flat) - real)

    def close(self) -> None:
        if self.size:
            self._write(-(-self.size // self.length))
        self.file.close()


def _write_files(directory: str, tokenizer: str, end_id: int, length: int, width: str):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(directory)
        encode = Encoder.load(tokenizer, width).encode
        end = np.array([end_id], width).tobytes()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        writer, sink, index, docs, at, first = None, None, None, 0, 0, None
        for batch in common.small(batches):
            if not batch.num_rows:
                continue
            if writer is None:
                sink = fs.open_output_stream(name + ".tmp")
                writer = _Writer(sink, length, pa.from_numpy_dtype(np.dtype(width)))
                index_sink = fs.open_output_stream(name + ".index.tmp")
                index = pa.ipc.new_file(index_sink, INDEX)
                first = batch["doc_id"][0].as_py()
            texts = [t or "" for t in batch["text"].to_pylist()]
            raw = [np.frombuffer(ids + end, width) for _, part in common.chunks(texts) for ids in encode(part)]
            sizes = np.array([len(r) for r in raw], np.int64)
            index.write_batch(pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=INDEX))
            for r in raw:
                writer.add(r)
            at += int(sizes.sum())
            docs += len(raw)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            fs.move(name + ".tmp", name + ".arrow")
            fs.move(name + ".index.tmp", name + ".index")
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "first_id": first, "documents": docs, "tokens": at}], schema)

    return run


def write(docs: DataFrame, directory: str, tokenizer_path: str, end_id: int = END_ID, sequence: int = SEQUENCE, partitions: int | None = None) -> DataFrame:
    """Writes doc_id, text of docs and returns the manifest: part, path, first_id, documents, tokens, start (tokens in
    the files before), one row a file."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = "uint16" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "uint32"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    manifest = common.materialize(common.map_arrow(dealt, _write_files(directory, tokenizer_path, end_id, sequence, width), "part int, path string, first_id bigint, documents bigint, tokens bigint"), "manifest")
    files = manifest.orderBy("part").collect()  # one row a partition
    start, out = 0, []
    for r in files:
        out.append((*r, start))
        start += r["tokens"]
    return spark.createDataFrame(out, "part int, path string, first_id bigint, documents bigint, tokens bigint, start bigint")


class TokenFile:
    """Random access to a file's tokens; values are views of the file's memory where the file system can map it."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def tokens(self, first: int, n: int) -> np.ndarray:
        """Tokens first to first + n; a view if one batch holds them."""
        step, parts = self.length * BATCH, []
        while n:
            b, at = divmod(first, step)
            flat = self.reader.get_batch(b).column("ids").flatten().to_numpy()[at : at + n]
            parts.append(flat)
            first, n = first + len(flat), n - len(flat)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence i."""
        batch, at = self.reader.get_batch(i // BATCH), i % BATCH
        return batch.column("ids")[at].values.to_numpy(), batch.column("mask")[at].values.to_numpy(zero_copy_only=False)


def read(manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the manifest's files, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(directory)
        for batch in common.small(batches):
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                tokens = TokenFile(fs, path + ".arrow")
                index = pa.ipc.open_file(fs.open_input_file(path + ".index"))
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    first, n = part["first"].to_numpy(), part["n_tokens"].to_numpy()
                    crc = [zlib.crc32(tokens.tokens(int(a), int(m)).astype("<u4").tobytes()) for a, m in zip(first, n)]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(first + start), part["n_tokens"], pa.array(crc, pa.int64())], schema=schema)

    n = manifest.count()
    return common.map_arrow(manifest.select("path", "start").repartition(max(1, n)), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
