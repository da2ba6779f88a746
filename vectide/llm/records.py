"""Token ids in length-delimited binary records, with a separate offset index.

A record is: length of the payload (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32 of the
payload (u32), one newline byte. All numbers are little-endian. The payload is doc_id (i64), ids (u32: their count),
then the ids as u16. The mask turns the checksum right by 15 bits and adds 0xA282EAD8. Files are parts of a range
partitioning by doc_id, so reading them in order of their names gives ascending ids; Spark's text writer commits them,
so that a lost executor leaves no half file. ``path/records`` holds them; ``path/index`` is a Parquet table with the
file, offset and length of each record, its ids' number and checksum, and its start among all ids: what a shuffled
reader needs (:func:`fetched`).

Texts are cut into atoms at white space and where letters end, which are bounds of the library's pre-tokenizer, and the
library encodes each distinct atom once while a worker remembers it. That holds for texts of printable ASCII and
accented Latin letters without the mark of special tokens; every other text is encoded whole by the library.

Defined cases: a null text counts as empty, so its record holds the end id alone; a null doc_id is written as the least
long, first; repeated ids and repeated rows are separate records, in the order of a hash of their texts, and may fill
several files; a very long text is one record; an empty table gives no rows and an empty index; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import WORKER_STATE, keep, picked, read, scratch_path

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Text that one file holds about, in bytes; a file is one row while it is written and read.
FILE_BYTES = 16 << 20
#: Atoms that a worker remembers at most, 50 bytes each, and characters that it encodes at once.
MEMORY_ATOMS = 300_000
BUFFER = 1 << 18
#: Rows that go to Python and back at once.
BATCH_ROWS = 512
MASK = 0xA282EAD8

# What the fast path takes: see the module's text.
_SAFE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]*")
MARK = "\x01"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Ids of atoms by two 64-bit hashes, in sorted arrays; beyond MEMORY_ATOMS the half that was asked for longest ago goes."""

    def __init__(self):
        self.key, self.check, self.at, self.used = (np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.n, self.pool, self.turn = np.empty(0, dtype=np.int64), np.empty(0, dtype="<u2"), 0

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``key``, and whether they hold it."""
        at = np.searchsorted(self.key, key)
        near = np.minimum(at, max(0, len(self.key) - 1))
        known = (self.key[near] == key) & (self.check[near] == check) if len(self.key) else np.zeros(len(key), dtype=bool)
        return near, known

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New keys, none of them among the old ones, with all their ids one after another."""
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        for name, new in (("key", key), ("check", check), ("n", n), ("at", len(self.pool) + np.cumsum(n) - n), ("used", np.full(len(key), self.turn))):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        self.pool = np.concatenate([self.pool, ids])

    def forget(self) -> None:
        self.turn += 1
        if len(self.key) > MEMORY_ATOMS:
            keep = np.argsort(-self.used, kind="stable")[: MEMORY_ATOMS // 2]
            keep.sort()
            self.pool = gathered(self.pool, self.at[keep], self.n[keep])
            self.key, self.check, self.n, self.used = self.key[keep], self.check[keep], self.n[keep], self.used[keep]
            self.at = np.cumsum(self.n) - self.n


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return pool[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)]


class Hasher:
    """Two 64-bit hashes of pieces of bytes, from running sums."""

    def __init__(self):
        rng = np.random.default_rng(17)
        self.letters = rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        self._grow(BUFFER)

    def _grow(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.power, self.inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, np.uint64(b))]) for b in (base, pow(base, -1, 1 << 64)))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            if len(data) > len(self.power):
                self._grow(len(data) + len(data) // 4)
            out = []
            for letters in self.letters:
                sums = letters[data]
                sums *= self.power[: len(data)]
                np.add.accumulate(sums, out=sums)
                z = sums[ends - 1]
                z[starts > 0] -= sums[starts[starts > 0] - 1]
                z *= self.inverse[starts]
                out.append((z ^ z >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9))
            return out


class Encoder:
    """Ids of texts as little-endian u16 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel; threads of its own only take memory
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        assert self.tokenizer.get_vocab_size() <= 1 << 16
        self.rules = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # the fast path's text is normal already: it is in lower case and its white space goes; and letters are one piece
        self.plain = normalizers.Sequence([]), self.tokenizer.pre_tokenizer
        self.letters = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (mark,) = self.ids([MARK], self.plain)
        (self.mark,) = mark.tolist()
        self.memory, self.hasher = Memory(), Hasher()
        self.kind = np.zeros(256, dtype=np.uint8)  # 0: other characters, 1: white space, 2: letters
        self.kind[[9, 10, 13, 32]] = 1
        self.kind[97:123] = self.kind[128:] = 2

    def ids(self, texts: list[str], rules) -> list[np.ndarray]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = rules
        return [np.array(x.ids, dtype="<u2") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [x for t in texts for x in self.ids([t], self.rules)]

    def learn(self, atoms: list[str], rules) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``atoms``, encoded many at a time with a mark after each that none of them holds, and their numbers."""
        ids, n = [np.empty(0, dtype="<u2")], [np.empty(0, dtype=np.int64)]
        for a in range(0, len(atoms), 2048):
            some = atoms[a : a + 2048]
            (got,) = self.ids([f" {MARK} ".join(some) + f" {MARK}"], rules)
            stops = np.flatnonzero(got == self.mark)
            assert len(stops) == len(some)
            ids.append(np.delete(got, stops))
            n.append(np.diff(np.r_[-1, stops]) - 1)
        return np.concatenate(ids), np.concatenate(n)

    def known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Places in the memory of the atoms that lie there; new ones are learnt first."""
        memory = self.memory
        memory.forget()
        key, check = self.hasher(data, starts, ends)
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        check = check[first]
        _, have = memory.find(key, check)
        raw, new, ids, n = data.tobytes(), [], [], []
        for rules, some in ((self.letters, ~have & letters[first]), (self.plain, ~have & ~letters[first])):
            new.append(np.flatnonzero(some))
            of = first[new[-1]]
            got = self.learn([raw[a:b].decode() for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)], rules)
            ids.append(got[0])
            n.append(got[1])
        memory.add(*(np.concatenate(x) for x in ([key[x] for x in new], [check[x] for x in new], ids, n)))
        at, have = memory.find(key, check)
        assert have.all()
        memory.used[at] = memory.turn
        return at[inverse]

    def fast(self, texts: list[str]) -> list[np.ndarray]:
        """Texts of the fast path, together of bounded size."""
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        kind = self.kind[data]
        before = np.r_[np.uint8(1), kind[:-1]]
        # a piece ends at white space, and where letters end, as the pre-tokenizer takes all letters that follow each other
        starts = np.flatnonzero((kind != 1) & ((before == 1) | (before == 2) & (kind != 2)))
        ends = np.flatnonzero((before != 1) & ((kind == 1) | (before == 2) & (kind != 2)))
        other = np.r_[0, np.cumsum(kind == 0)]
        at = self.known(data, starts, ends, other[ends] == other[starts])
        n = self.memory.n[at]
        ids, so_far = gathered(self.memory.pool, self.memory.at[at], n), np.r_[0, np.cumsum(n)]
        sizes = np.array([len(p) + 1 for p in parts])
        bounds = so_far[np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        fast = [_SAFE.fullmatch(t) is not None and "<|" not in t for t in texts]
        pieces, of = [], []
        for i, (t, f) in enumerate(zip(texts, fast, strict=True)):
            for p in cut(t) if f else ():
                pieces.append(p)
                of.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        a = 0
        while a < len(pieces):
            b, size = a, 0
            while b < len(pieces) and (b == a or size + len(pieces[b]) < BUFFER):
                size += len(pieces[b])
                b += 1
            for i, x in zip(of[a:b], self.fast(pieces[a:b]), strict=True):
                out[i].append(x)
            a = b
        for i, f in enumerate(fast):
            if not f:
                out[i] = self.whole([texts[i]])
        return [x[0].tobytes() if len(x) == 1 else b"".join(y.tobytes() for y in x) for x in out]


def cut(text: str) -> list[str]:
    """A text in pieces of about BUFFER characters that end at spaces."""
    out, a = [], 0
    while len(text) - a > BUFFER:
        b = text.find(" ", a + BUFFER)
        if b < 0:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def encoder_of_worker(path: str) -> Encoder:
    """The encoder of this Python process: tasks of a reused worker share it. Functions come by value and so share no
    module, so it is kept in one that is made here."""
    own = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE))
    held = own.__dict__.setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def framed(doc_id: int, ids: bytes) -> bytes:
    payload = struct.pack("<qI", doc_id, len(ids) // 2) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)), b"\n"))


def parsed(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """offset, length, doc_id and ids of each record of a file; raises where a checksum fails. The writer's last newline
    ends the last record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head = bytes(view[at : at + 8])
        (n,) = struct.unpack("<Q", head)
        if struct.unpack_from("<I", data, at + 8)[0] != masked(head):
            raise ValueError(f"the length at {at} is damaged")
        payload = view[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"the payload at {at} is damaged")
        doc_id, count = struct.unpack_from("<qI", payload)
        yield at, n + 17, doc_id, np.frombuffer(payload, dtype="<u2", count=count, offset=12)
        at += n + 17


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send so many rows at once to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> str:
    """Encode every text and write record files and their index below ``path``; returns ``path``."""
    vocabulary = vocabulary or vocabulary_path()
    end = struct.pack("<H", end_id)
    docs = picked(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    # the row's number only deals equal rows to files: they are alike
    rows = rows.repartitionByRange(files, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def encode(batches):
        encoder = encoder_of_worker(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                ids = encoder.encode(part.column(1).to_pylist())
                # the writer adds each row's newline
                records = [framed(d, x + end)[:-1] for d, x in zip(part.column(0).to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        rows.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.text(f"{path}/records")
        write_index(docs.sparkSession, path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: file (its number in order), content."""
    name = F.regexp_extract("path", "part-(\\d+)", 1).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(name.alias("file"), "content")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Read every record back: file, offset, length, doc_id, n_tokens, ids_crc32, before (ids in the file before it)."""
    names = ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "before"]
    kinds = [pa.int32(), *[pa.int64()] * 6]

    def records(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, before = [], 0
                for at, n, d, ids in parsed(content.as_buffer()):
                    out.append((number, at, n, d, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                columns = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return read_files(spark, path).mapInArrow(records, "file int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long")


def write_index(spark: SparkSession, path: str) -> None:
    """Read the files in ``path`` back and write their offset index. The driver sees nothing; the running sum goes over
    one row for each file."""
    with batches_of(spark, 1):  # one file is one row
        rows = keep(digest(spark, path), "records-index")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rows.join(starts, "file").withColumn("start", F.col("first") + F.col("before")).drop("first", "before").write.parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the files in ``path``: file, offset, length, doc_id, n_tokens, ids_crc32, start."""
    return spark.read.schema("file int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, start long").parquet(f"{path}/index")


def fetched(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted`` (rows of the index: file, offset, length) names, in any order: doc_id, ids."""
    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("places"))  # bounded by the file

    def cut(batches):
        for batch in batches:
            for content, some in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                got = [(d, ids) for p in some for _, _, d, ids in parsed(data[p["offset"] : p["offset"] + p["length"]])]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([ids.astype(np.int32) for _, ids in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return read_files(spark, path).join(places, "file").select("content", "places").mapInArrow(cut, "doc_id long, ids array<int>")


def tokenized(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as record files in the shared folder and return the index made by reading them back."""
    spark = docs.sparkSession
    return index(spark, write(docs, scratch_path(spark, "records")))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(read(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


QUERIES = {"op10_records": op10_records}
