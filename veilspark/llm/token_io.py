"""Token-ID output: patched frame-of-reference blocks.

A shard is one byte string: header, document lengths, blocks of ids, then the index of block starts. A block subtracts
its minimum, packs the differences at the width that holds ``PERCENT`` of them, and lists the rest as exceptions
(position, value). Shards are rows ``(part, seq, start, n_docs, n_ids, payload)`` written through Spark's own file
committer, so a retried task replaces what it had begun and any Hadoop path works.

Defined results: a null text is encoded as an empty one; rows with equal ids are all written, ordered by id, then text;
null ids come first; ids are integers (a text that is no number raises); an empty table gives no shard; other columns
are never read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import UnitIds, bound_batches, in_slices, shared_path

MAGIC = b"PFR1"
BLOCK = 2048
PERCENT = 95
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 20
#: Bytes of chunks of text and their ids that a worker remembers.
CHUNK_BYTES = 64 << 20


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, count=count * width, bitorder="little").reshape(count, width)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray) -> bytes:
    """One block: minimum, width, counts, packed differences, exception positions and values."""
    low = ids.min()
    rest = ids - low
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENT // 100)[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    packed = rest.copy()
    packed[odd] = 0
    body = _pack(packed, width) if width else b""
    return struct.pack("<IBHH", int(low), width, len(ids), len(odd)) + body + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def decode_block(data: memoryview, at: int) -> np.ndarray:
    low, width, count, odd = struct.unpack_from("<IBHH", data, at)
    at += 9
    size = (count * width + 7) // 8
    out = _unpack(np.frombuffer(data, np.uint8, size, at), count, width) if width else np.zeros(count, np.uint32)
    at += size
    if odd:
        where = np.frombuffer(data, "<u2", odd, at)
        out[where] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return out + np.uint32(low)


def _blocks(values: np.ndarray) -> list[bytes]:
    return [encode_block(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]


def encode_shard(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """``ids`` of consecutive documents of ``lengths`` ids each, as one byte string."""
    ids = np.ascontiguousarray(ids, np.uint32)
    parts = [*_blocks(np.ascontiguousarray(lengths, np.uint32)), *_blocks(ids)]
    starts = np.cumsum([0, *map(len, parts)], dtype=np.uint64) + 20
    return b"".join((MAGIC, struct.pack("<QII", len(ids), len(lengths), len(parts)), *parts, starts.astype("<u8").tobytes()))


def read_ids(payload: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a shard; only the blocks that hold them are decoded, by the index."""
    n_ids, n_docs, n_parts = _header(payload)
    skip = -(-n_docs // BLOCK)
    return _read(payload, skip, n_ids, n_parts, first, n_ids - first if count is None else count)


def read_lengths(payload: bytes) -> np.ndarray:
    _, n_docs, n_parts = _header(payload)
    return _read(payload, 0, n_docs, n_parts, 0, n_docs)


def _header(payload: bytes) -> tuple[int, int, int]:
    if payload[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    return struct.unpack_from("<QII", payload, 4)


def _read(payload: bytes, skip: int, total: int, n_parts: int, first: int, count: int) -> np.ndarray:
    if not 0 <= first <= first + count <= total:
        raise ValueError(f"ids {first} to {first + count} of {total}")
    if not count:
        return np.empty(0, np.uint32)
    index = np.frombuffer(payload, "<u8", n_parts + 1, len(payload) - 8 * (n_parts + 1))
    view = memoryview(payload)
    b0, b1 = first // BLOCK, (first + count - 1) // BLOCK
    out = np.concatenate([decode_block(view, int(index[skip + b])) for b in range(b0, b1 + 1)])
    return out[first - b0 * BLOCK : first - b0 * BLOCK + count]


#: Letters that every Unicode version has as such and as their own composed form.
_PLAIN = "a-zß-öø-ÿ"
_WORD = re.compile(f"[{_PLAIN}]+")
_TAIL = f"([{_PLAIN}])([.,!?;:#$%*&|)]+)([ \\n]|$)"


class ChunkEncoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of chunks between spaces and newlines.

    It is for tokenizers that lower-case, drop white space before any other step, and never join letters with
    punctuation, so that the ids of a text are those of its chunks in order. New chunks of plain letters are encoded
    together: each is one word, and the last of its ids is one that ends a word. Texts that hold the string of a
    special token are encoded whole.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids = UnitIds(self._learn, " ", CHUNK_BYTES)
        # Words of plain letters need no normalizing, and white space alone divides them; kept only if a sample agrees.
        from tokenizers import normalizers, pre_tokenizers

        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        sample = "the of house straße élève año under international zzqx ll s t re ve m d ß ÿ " + " ".join(map(chr, range(97, 123)))
        if self.plain.encode(sample, add_special_tokens=False).ids != self.tokenizer.encode(sample, add_special_tokens=False).ids:
            self.plain = self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chunks, those of plain letters first, with their ids and the number of each."""
        plain = list(map(bool, map(_WORD.fullmatch, chunks)))
        words, rest = list(compress(chunks, plain)), [c for c, p in zip(chunks, plain, strict=True) if not p]
        ids, sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        if words:
            ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            sizes = np.diff(stops, prepend=0)
            if len(stops) != len(words):
                words, rest, ids, sizes = [], chunks, ids[:0], sizes[:0]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        more = np.fromiter(chain.from_iterable(found), np.uint32)
        return words + rest, np.r_[ids, more], np.r_[sizes, np.fromiter(map(len, found), np.int64, len(found))]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of an array without nulls."""
        low = pc.ascii_lower(texts)
        holds = [pc.match_substring(low, x).to_numpy(zero_copy_only=False) for x in self.special]
        whole = np.flatnonzero(np.logical_or.reduce(holds)) if holds else ()
        spaced = pc.replace_substring_regex(pc.replace_substring(low, "\n", " "), _TAIL, r"\1 \2\3")
        joined, sizes = self.ids(pc.split_pattern(spaced, " "))
        out = np.split(joined, np.cumsum(sizes)[:-1]) if len(sizes) else []
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


SHARD_SCHEMA = "part long, seq long, start long, n_docs long, n_ids long, doc_ids array<long>, payload binary"


def write_shards(docs: DataFrame, path: str, encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]], end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, write shards in ascending id order.

    One range shuffle brings the texts into order; ``start`` of a shard counts the ids before it in its own part only,
    the parts' totals are added on reading.
    """
    from pyspark import TaskContext

    bound_batches(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder()
        seq = start = held = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

        def shard() -> pa.RecordBatch:
            payload = encode_shard(np.concatenate(ids), np.array([len(x) for x in ids], np.uint32))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start": start, "n_docs": len(ids), "n_ids": held, "doc_ids": names, "payload": payload}], schema)

        for b in batches:
            for doc, found in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                own = np.append(found, np.uint32(end_id))
                ids.append(own)
                names.append(doc)
                held += len(own)
                if held >= SHARD_IDS:
                    yield shard()
                    seq, start, held, ids, names = seq + 1, start + held, 0, [], []
        if ids:
            yield shard()

    ordered.mapInArrow(in_slices(run, 1), SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards below ``path``: doc_id, start, n_tokens, ids_crc32, all from the bytes read back."""
    bound_batches(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # One row of 16 bytes per partition of one range shuffle, never per document: the broadcast and the window over it
    # are bounded by that number of partitions.
    before = parts.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                payload = row["payload"]
                lengths, ids = read_lengths(payload).astype(np.int64), read_ids(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"] + row["before"]), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return shards.join(F.broadcast(before), "part").select("before", "start", "doc_ids", "payload").mapInArrow(run, schema)


def token_file_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents to a fresh folder in the shared directory and read the files back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write_shards(docs, path, lambda: ChunkEncoder(tokenizer_file), end_id)
    return read_documents(spark, path)
