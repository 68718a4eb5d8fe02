"""Operator 9: BPE encoding and decoding through a table of distinct words.

A text's tokens are the tokens of its words, in order: the tokenizer drops
white space before it merges, and no token or special token spans any. So

1. texts are split into words; a block of documents (BLOCK bytes of text)
   keeps each word once, and its texts as codes of those words;
2. the blocks' words meet in hash partitions, where each distinct word of the
   corpus is encoded once, by the tokenizers library;
3. the ids join back to the block by word position, where texts are put
   together; decoding joins each id to its piece (a table as large as the
   vocabulary) and the pieces by one space.

Only words and codes are shuffled, once, compressed, and each distinct word of
a block once; the texts are read once for the words and once for the codes. A
partition holds the words of one hash value and a block its own documents, so
neither grows with a common word or a hot source. A block is named after its
content: blocks of equal content are one, given as often as they occur, and a
block that arrives incomplete raises instead of giving wrong ids.

Defined results: null text is empty, and an empty or blank text has no ids
(n_tokens 0, digests of the empty string); equal rows, repeated ids and null
ids each give a row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections import Counter, defaultdict
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import release, small_batches

#: Bytes of text of a block.
BLOCK = 1 << 24
#: Most words whose ids a task remembers; it forgets all beyond that, and encodes them again.
REMEMBERED = 500_000
#: The library's encodings, objects of about 1 KB each, are held of so many words at once.
BATCH = 1 << 12
#: About so many tokens of a block are spelt out at once.
TOKENS = 1 << 18
_ROW = "part int, block string, kind int, payload binary"
_FIELDS = pa.schema([("part", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("payload", pa.binary())])
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a process, without truncation and padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def pieces(path: str) -> list[str]:
    """The id-to-piece table, by id; ids that the vocabulary lacks are empty."""
    key = (path, "pieces")
    if key not in _loaded:
        vocab = tokenizer(path).get_vocab(with_added_tokens=True)
        table = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            table[i] = piece
        del vocab
        forget()
        _loaded[key] = table
    return _loaded[key]


def forget() -> None:
    """Let a worker's tokenizers and tables go, some 40 MB each: the next step has no use for them."""
    _loaded.clear()
    release()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as byte planes, low bytes first, in one zstandard frame."""
    arrays = [np.ascontiguousarray(a, np.uint32) for a in arrays]
    widths = [4 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8) for a in arrays]
    # The frame takes plane after plane, so that only one is held beside the arrays.
    frame = zstandard.ZstdCompressor(level=3).compressobj(size=sum(9 + len(a) * w for a, w in zip(arrays, widths, strict=True)))
    out = []
    for a, width in zip(arrays, widths, strict=True):
        out.append(frame.compress(len(a).to_bytes(8, "little") + bytes([width])))
        planes = a.view(np.uint8).reshape(-1, 4)
        out += [frame.compress(planes[:, k].tobytes()) for k in range(width)]
    out.append(frame.flush())
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, p = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while p < len(raw):
        n, width = int.from_bytes(raw[p : p + 8], "little"), raw[p + 8]
        a, p = np.zeros((n, 4), np.uint8), p + 9
        for k in range(width):
            a[:, k] = np.frombuffer(raw, np.uint8, n, p)
            p += n
        out.append(a.view(np.uint32).reshape(-1))
    return out


class _Block:
    """Documents of a block as codes of its words, which are numbered as they come."""

    def __init__(self, coded: bool):
        self.coded, self.ids, self.places, self.counts, self.codes, self.size = coded, [], [], [], array("I"), 0
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.digest = hashlib.blake2b(digest_size=16)

    def add(self, doc_id, text: bytes, place: int) -> None:
        found = text.split()
        self.ids.append(doc_id)
        self.places.append(place)
        if self.coded:
            self.counts.append(len(found))
            self.codes.extend(map(self.words.__getitem__, found))
        else:
            self.words.update(dict.fromkeys(found))
        self.size += len(text)
        self.digest.update(f"{doc_id} {place} {len(text)} ".encode())
        self.digest.update(text)

    def rows(self, parts: int):
        """The row of codes, or a row of words for each hash partition."""
        name, words = self.digest.hexdigest(), list(self.words)
        self.words.clear()
        part = np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(parts)
        if self.coded:
            known = np.array([x is not None for x in self.ids], np.uint32)
            ids = np.array([x or 0 for x in self.ids], np.int64).view(np.uint32)
            places = np.array(self.places, np.int64).view(np.uint32)
            yield 0, name, 1, _pack(known, ids, places, np.array(self.counts, np.uint32), part, np.frombuffer(self.codes, np.uint32))
            return
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for p in range(parts):
            i, j = bounds[p], bounds[p + 1]
            if i < j:
                yield p, name, 0, squeeze(b" ".join([words[k] for k in order[i:j]]))


def _rows(rows) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, c, d), _FIELDS, strict=True)], schema=_FIELDS)


def _split(parts: int, limit: int, coded: bool):
    def run(batches):
        forget()
        block = _Block(coded)
        for batch in batches:
            for doc_id, text, place in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                block.add(doc_id, text.as_py() or b"", place)
                if block.size >= limit:
                    if rows := list(block.rows(parts)):
                        block = None
                        yield _rows(rows)
                    block, rows = _Block(coded), None
            # It goes before the next one comes.
            batch = text = None
        if block.ids and (rows := list(block.rows(parts))):
            yield _rows(rows)
        del block
        release()

    return run


def _encode(path: str):
    def run(batches):
        t, known = tokenizer(path), {}
        for batch in batches:
            out = []
            for part, block, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = zstandard.ZstdDecompressor().decompress(payload).split(b" ")
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in words if w not in known]
                for i in range(0, len(new), BATCH):
                    some = new[i : i + BATCH]
                    for w, e in zip(some, t.encode_batch([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[w] = array("I", e.ids).tobytes()
                ids = [known[w] for w in words]
                n = np.fromiter(map(len, ids), np.uint32, len(ids)) // np.uint32(4)
                out.append((part, block, kind, _pack(n, np.frombuffer(b"".join(ids), np.uint32))))
            if out:
                yield _rows(out)
        del known
        release()

    return run


def _gather(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[f : f + n] of each first place and length, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(first - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


def _sha256(texts: pa.Array) -> list[str]:
    """The digests of a large_string array, none of which is copied."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset).tolist()
    held = memoryview(data if data is not None else b"")
    return [hashlib.sha256(held[i:j]).hexdigest() for i, j in pairwise(at)]


def _join(path: str, digest: bool, placed: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kinds, seen = table.column("kind").to_pylist(), Counter()
        times = kinds.count(1)  # blocks of this content
        if not times:
            raise RuntimeError("a block came apart: its codes are missing")
        known, ids, places, counts, part, codes = _unpack(table.column("payload")[kinds.index(1)].as_py())
        ids = ids.view(np.int64)
        # A word's ids are lengths[code] of `flat`, from first[code] on.
        lengths, first = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        done, flats, held = np.zeros(len(part), bool), [np.zeros(0, np.uint32)], 0
        for i, kind in enumerate(kinds):
            if kind == 0:
                p = table.column("part")[i].as_py()
                seen[p] += 1
                if seen[p] > 1:
                    continue
                n, flat = _unpack(table.column("payload")[i].as_py())
                at = np.flatnonzero(part == p)
                if len(at) != len(n):
                    raise RuntimeError("a block came apart: its words differ between runs")
                done[at], lengths[at], first[at] = True, n, held + np.cumsum(n, dtype=np.int64) - n
                flats.append(flat)
                held += len(flat)
        if not done.all() or any(n != times for n in seen.values()):
            raise RuntimeError("a block came apart: words are missing")
        # Decoding joins the block's distinct ids to the id-to-piece table; a token is the place of its id there.
        flat = np.concatenate(flats)
        used = np.zeros(int(flat.max(initial=0)) + 1, bool)
        used[flat] = True
        flat, used = (np.cumsum(used, dtype=np.int32) - 1)[flat], pa.table({"id": pa.array(np.flatnonzero(used))})
        used = used.join(pa.table({"id": pa.array(range(len(pieces(path))), pa.int64()), "piece": pa.array(pieces(path), pa.large_string())}), "id", use_threads=False).sort_by("id").combine_chunks()
        number, piece = used.column("id").combine_chunks(), used.column("piece").combine_chunks()
        begin = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        tokens, i = np.zeros(len(ids) + 1, np.int64), 0
        while i < len(ids):
            # As below, documents of TOKENS words at a time.
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + TOKENS, "right")) - 1)
            sums = np.concatenate(([0], np.cumsum(lengths[codes[begin[i] : begin[j]]])))
            tokens[i + 1 : j + 1] = tokens[i] + sums[begin[i + 1 : j + 1] - begin[i]]
            i = j
        out_ids, n_tokens = pa.array(ids, pa.int64(), mask=known == 0), pa.array(np.diff(tokens))
        blank, one, two, i = pa.scalar(" ", pa.large_string()), [], [], 0
        while i < len(ids):
            # Documents of TOKENS tokens at a time (a longer one alone), so that only these are spelt out.
            j = max(i + 1, int(np.searchsorted(tokens, tokens[i] + TOKENS, "right")) - 1)
            c = codes[begin[i] : begin[j]]
            which = pa.array(_gather(flat, first[c], lengths[c]))
            spelt = lambda words: pa.LargeListArray.from_arrays(pa.array(tokens[i : j + 1] - tokens[i]), words.take(which))  # noqa: B023, E731
            decoded = pc.binary_join(spelt(piece), blank)
            if digest:
                one += _sha256(pc.binary_join(spelt(number.cast(pa.large_string())), blank))
                two += _sha256(decoded)
            else:
                one.append(spelt(number.cast(pa.int32())).cast(pa.list_(pa.int32())))
                two.append(decoded.cast(pa.string()))
            i = j
        if digest:
            out = pa.table({"doc_id": out_ids, "n_tokens": n_tokens, "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())})
        else:
            out = pa.table({"doc_id": out_ids, "n_tokens": n_tokens, "ids": pa.chunked_array(one, pa.list_(pa.int32())), "decoded": pa.chunked_array(two, pa.string())})
        if placed:
            out = out.append_column("position", pa.array(places.view(np.int64)))
        del flats, flat, lengths, first, codes
        release()
        return pa.concat_tables([out] * times)

    return run


def encode(docs: DataFrame, path: str, digest: bool = False, block_bytes: int = BLOCK, position: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and ids with decoded text, or (digest) their SHA-256; a position (long) goes along.

    docs is read twice and has to come the same both times, as stored files do.
    """
    small_batches(docs.sparkSession)
    parts = min(65_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.lit(0) if position is None else position
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.cast("long").alias("place"))
    words = rows.mapInArrow(_split(parts, block_bytes, False), _ROW).repartition(parts, "part").mapInArrow(_encode(path), _ROW)
    encoded = words.unionByName(rows.mapInArrow(_split(parts, block_bytes, True), _ROW))
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string") + ("" if position is None else ", position long")
    return encoded.groupBy("block").applyInArrow(_join(path, digest, position is not None), schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digest=True)
