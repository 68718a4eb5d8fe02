"""Operator 4: token-id files with a shared zstandard dictionary.

A data set is a folder with `dict-<sha256>.zdict`, a dictionary trained on the
serialised ids of SAMPLE_DOCS documents (the smallest by a hash of their id; of
each, its first SAMPLE_IDS ids: a bound of the dictionary's training alone),
and one shard for each partition of the documents in ascending doc_id order.
A shard is

    b"TOKSHRD1", uint32 length and JSON header (dictionary hash, bytes an id)
    one zstandard frame a document
    index: uint64 frame offsets (n + 1), int64 doc_ids, uint8 whether the id
           is known, uint32 numbers of ids
    uint64 place of the index, uint64 n, b"TOKSHRD1"

so one short document is read with the index and one frame. Shards are written
under another name and renamed, so a repeated task leaves the same file.

Defined results: null and empty texts hold the end id alone; rows without id
come first; rows of equal ids stand in order of their text, nulls first; an
empty table gives no shard and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triage.llm.bpe import tokenizer
from triage.llm.common import scratch_path, stored

MAGIC = b"TOKSHRD1"
if sys.byteorder != "little":
    raise ImportError("shards are written in the machine's byte order, which has to be little-endian")
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES, LEVEL = 400, 8192, 65_536, 3
#: Most segments that a worker remembers; it forgets all beyond that.
REMEMBERED = 1_200_000

_SEGMENT = re.compile(r"[ \t-\r]*(?:[^\W_]++(?=[,.!?;:])|[^ \t-\r]+)|[ \t-\r]+")
#: Control characters and white space beside which a segment's tokens may depend on its neighbour.
_WIDE = re.compile("[\x00-\x08\x0e-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: Where a byte-level pre-tokenizer parts a text.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters and digits of these are the same in every Unicode version.
_OLD = re.compile("[\t-\r -~\xa1-\u024f]*")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte: printable ones stand for themselves, the others follow from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Segments and the bytes of their ids; a new one is parted, and each part that is new is encoded."""

    letters = _byte_letters()

    def __init__(self, t, code: str):
        super().__init__()
        self.t, self.code, self.merge = t, code, t.model.tokenize

    def __missing__(self, s: str) -> bytes:
        if not _OLD.fullmatch(s):
            found = array(self.code, self.t.encode(s, add_special_tokens=False).ids).tobytes()
        elif len(parts := _PARTS.findall(s)) > 1:
            found = b"".join([self[x] for x in parts])
        else:
            found = array(self.code, [x.id for x in self.merge(s.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[s] = found
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes.

    A byte-level pre-tokenizer never joins a word with what follows it, so a
    run of blanks with the word behind it (letters or digits up to a mark such
    as a comma, where a token always ends) is encoded once and remembered by
    the process. Texts with other white space or special tokens, and all texts
    of other tokenizers, are encoded whole.
    """

    _of: dict = {}

    def __new__(cls, path: str):
        if path not in cls._of:
            cls._of[path] = super().__new__(cls)
            cls._of[path].known = None
        return cls._of[path]

    def __init__(self, path: str):
        if self.known is not None:
            return
        self.t = tokenizer(path)
        made = json.loads(self.t.to_str())
        plain = not made["normalizer"] and made["pre_tokenizer"] == _BYTE_LEVEL and made["model"]["type"] == "BPE"
        special = "|".join(re.escape(x.content) for x in self.t.get_added_tokens_decoder().values()) or "(?!)"
        self.whole = re.compile(f"{special}|{_WIDE.pattern}" if plain else "")
        self.kind = np.dtype("<u2" if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"  # of the machine, which is little-endian
        self.known = _Known(self.t, self.code)

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        look, whole, out = self.known.__getitem__, self.whole.search, []
        for x in texts:
            if whole(x):
                out.append(self.pack(self.t.encode(x, add_special_tokens=False).ids))
            elif "  " in x or "\n\n" in x or " \n" in x or "\n " in x or "\t" in x or "\r" in x or "\v" in x or "\f" in x:
                out.append(b"".join(map(look, _SEGMENT.findall(x))))
            else:  # blanks and line ends stand alone: each begins a segment
                out.append(b"".join(map(look, x.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"))) if x else b"")
        return out


def _open(uri: str):
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def put(uri: str, chunks) -> None:
    """Write a file whole: under another name first, then renamed."""
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(other, compression=None) as f:
        for x in chunks:
            f.write(x)
    system.move(other, path)


def get(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.readall()


def train(docs: DataFrame, path: str, end_id: int) -> bytes:
    """The dictionary, b"" if there is too little text for one."""
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    wanted = [r[0] for r in ids.collect()]
    head = F.substring(F.coalesce("text", F.lit("")), 1, 4 * SAMPLE_IDS)
    rows = docs.filter(F.col("doc_id").isin(wanted)).groupBy("doc_id").agg(F.min(head).alias("text")).collect()
    enc = Encoder(path)
    end = enc.pack([end_id])
    samples = [x[: SAMPLE_IDS * enc.kind.itemsize] + end for x in enc.encode([r.text for r in sorted(rows)])]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(path: str, folder: str, zdict: bytes, end_id: int):
    digest = hashlib.sha256(zdict).hexdigest()

    def run(batches):
        shard = TaskContext.get().partitionId()
        enc = Encoder(path)
        end = enc.pack([end_id])
        kw = {"dict_data": zstandard.ZstdCompressionDict(zdict)} if zdict else {}
        squeeze = zstandard.ZstdCompressor(level=LEVEL, **kw).compress
        ids, sizes, offsets = [], [], []

        def body():
            head = json.dumps({"dictionary": digest, "id_bytes": enc.kind.itemsize}).encode()
            at = len(MAGIC) + 4 + len(head)
            yield MAGIC + len(head).to_bytes(4, "little") + head
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    ids.extend(part.column(0).to_pylist())
                    for x in enc.encode([t or "" for t in part.column(1).to_pylist()]):
                        offsets.append(at)
                        sizes.append(len(x) // enc.kind.itemsize + 1)
                        frame = squeeze(x + end)
                        at += len(frame)
                        yield frame
            offsets.append(at)
            yield np.array(offsets, "<u8").tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + np.array([x is not None for x in ids], "u1").tobytes() + np.array(sizes, "<u4").tobytes()
            yield at.to_bytes(8, "little") + len(ids).to_bytes(8, "little") + MAGIC

        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        name = f"shard-{shard:08d}.tok"
        put(f"{folder}/{name}", body())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["shard", "name", "n_docs", "n_tokens"])

    return run


def _chain(first, rest):
    yield first
    yield from rest


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes the data set; returns its manifest: shard, name, n_docs, n_tokens and start, the ids before it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    zdict = train(docs, path, end_id)
    put(f"{folder}/dict-{hashlib.sha256(zdict).hexdigest()}.zdict", [zdict])
    dealt = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    shards = stored(dealt.mapInArrow(_writer(path, folder, zdict, end_id), "shard long, name string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """A shard, opened for reading; keeps the index and reads frames as asked."""

    def __init__(self, folder: str, name: str, dictionaries: dict | None = None):
        system, path = _open(f"{folder}/{name}")
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if tail[16:] != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        place, self.n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        length = int.from_bytes(self.file.read_at(4, 8), "little")
        head = json.loads(self.file.read_at(length, 12))
        self.kind = np.dtype(f"<u{head['id_bytes']}")
        index = self.file.read_at(size - 24 - place, place)
        n = self.n
        self.offsets = np.frombuffer(index, "<u8", n + 1).astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
        self.known = np.frombuffer(index, "u1", n, 16 * n + 8) > 0
        self.sizes = np.frombuffer(index, "<u4", n, 17 * n + 8).astype(np.int64)
        held = dictionaries if dictionaries is not None else {}
        if (key := head["dictionary"]) not in held:
            raw = get(f"{folder}/dict-{key}.zdict")
            if hashlib.sha256(raw).hexdigest() != key:
                raise ValueError("the dictionary is not the one that the shard was written with")
            held[key] = zstandard.ZstdCompressionDict(raw) if raw else None
        self.open = zstandard.ZstdDecompressor(**({"dict_data": held[key]} if held[key] else {})).decompress

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, its end id last."""
        raw = self.open(self.file.read_at(int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i])))
        return np.frombuffer(raw, self.kind)

    def find(self, doc_id: int) -> np.ndarray | None:
        lo = int(np.count_nonzero(~self.known))
        i = lo + int(np.searchsorted(self.ids[lo:], doc_id))
        return self.document(i) if i < self.n and self.known[i] and self.ids[i] == doc_id else None


def _reader(folder: str):
    def run(batches):
        held: dict = {}
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name, held)
                starts = start + np.concatenate(([0], np.cumsum(shard.sizes)[:-1]))
                for i in range(0, shard.n, 4096):
                    j = min(shard.n, i + 4096)
                    arrays = [shard.document(k) for k in range(i, j)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.ids[i:j], pa.int64(), mask=~shard.known[i:j]),
                            pa.array(starts[i:j]),
                            pa.array([len(x) for x in arrays], pa.int64()),
                            pa.array([crc32(x.astype("<u4").tobytes()) for x in arrays], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens and ids_crc32."""
    rows = manifest.select("name", "start")
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "name").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    return read_back(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder), folder)
