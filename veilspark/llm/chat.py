r"""Chat formatting: columnar byte assembly.

A turn is written as ``### Role: text</turn>\n``. Inside roles and texts the control strings are escaped reversibly: a
backslash is doubled, ``##`` becomes ``#\#``, ``</turn>`` becomes ``<\/turn>`` (in roles also a colon with a space becomes ``:\ `` with a backslash between), so no
control string stands inside a text. Segment lengths, cumulative offsets and scatter indices are computed in numpy and
headers, contents and ends are copied into one preallocated buffer per batch.

The output is one row per conversation: its formatted text and the code-point spans of the loss mask (the texts of
assistant turns). A conversation too large for one batch gives several consecutive parts, so memory stays bounded.

Defined results: null texts and roles are empty; turns with equal numbers are ordered by role, then text, null turns
come first; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives no row; ids
and turns are integers (a text that is no number raises);
columns other than the four named ones are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import bound_batches

HEAD, COLON, END = "### ", ": ", "</turn>\n"
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Bytes of turns kept back for the next batch so that a conversation is written whole.
HOLD_BYTES = 4 << 20

PART_SCHEMA = "conv_id long, part long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(texts: pa.Array) -> pa.Array:
    for a, b in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        texts = pc.replace_substring(texts, a, b)
    return texts


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths and the joined bytes of a string array."""
    a = a.cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return np.diff(offsets), np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted texts of the runs of ``conv``; the first turn of each; starts and lengths in code points of every turn's text."""
    n = len(conv)
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    role_names = roles.dictionary_encode()
    heads = pc.binary_join_element_wise(HEAD, pc.replace_substring(escape(role_names.dictionary), COLON, ":\\ "), COLON, "").take(role_names.indices)
    content = escape(texts)
    segments = [_bytes(heads), _bytes(content), (np.full(n, len(END)), np.frombuffer(END.encode() * n, np.uint8))]
    lengths = np.stack([x[0] for x in segments], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 3)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, -1]), np.uint8)
    for k, (own, data) in enumerate(segments):
        source = np.cumsum(own) - own
        buffer[np.arange(len(data)) + np.repeat(starts[:, k] - source, own)] = data
    bounds = np.r_[starts[first, 0], ends[-1, -1]].astype(np.int64)
    out = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(buffer)])
    # Code points: bytes that do not continue a character.
    points = np.r_[0, np.cumsum((buffer & 0xC0) != 0x80)]
    origin = np.repeat(points[bounds[:-1]], np.diff(np.r_[first, n]))
    begin, stop = points[starts[:, 1]] - origin, points[ends[:, 1]] - origin
    return out, first, begin, stop


def format_conversations(conversations: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Rows ``(conv_id, part, formatted, loss_starts, loss_ends)``; the parts of a conversation are consecutive rows of one partition."""
    bound_batches(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        part: dict[int | None, int] = {}

        def write(t: pa.Table) -> pa.RecordBatch:
            nonlocal part
            t = t.combine_chunks()
            ids, roles, texts = (t.column(i).combine_chunks() for i in range(3))
            # Nulls sort first; a number that no neighbour has stands for them.
            keys = np.unique(pc.fill_null(ids, -(2**63)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, keys)
            formatted, first, begin, stop = assemble(keys, roles, texts)
            names = [ids[int(i)].as_py() for i in first]
            mask = pc.equal(roles, train_role).to_numpy(zero_copy_only=False)
            counts = np.add.reduceat(mask.astype(np.int64), first)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            numbers = []
            for x in names:
                numbers.append(part.get(x, 0))
                part = {x: numbers[-1] + 1}
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(numbers, pa.int64()), formatted.cast(pa.string()), pa.ListArray.from_arrays(offsets, pa.array(begin[mask])), pa.ListArray.from_arrays(offsets, pa.array(stop[mask]))],
                ["conv_id", "part", "formatted", "loss_starts", "loss_ends"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            ids = held.column(0)
            last = ids[-1].as_py()
            cut = len(ids) - 1
            flags = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
            where = pc.index(flags, True).as_py()
            cut = where if where >= 0 else cut
            if held.slice(cut).nbytes > HOLD_BYTES:
                cut = len(ids)
            if cut:
                yield write(held.slice(0, cut))
            held = held.slice(cut) if cut < len(ids) else None
        if held is not None:
            yield write(held)

    return turns.mapInArrow(run, PART_SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of one formatted text."""
    turns = []
    for x in formatted.split(END)[:-1]:
        if not x.startswith(HEAD):
            raise ValueError("a turn without its header")
        role, _, text = x[len(HEAD) :].partition(COLON)
        turns.append((unescape(role), unescape(text)))
    return turns


def digest(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted parts: turns, their digest, the text under the loss mask, characters."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([T.StructField(x, T.StringType() if "sha" in x else T.LongType()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def done() -> dict:
            return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for b in batches:
            out = []
            for p in b.to_pylist():
                if p["part"] == 0:
                    if row is not None:
                        out.append(done())
                    row = {"conv_id": p["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = p["formatted"]
                for role, content in read_turns(text):
                    row["n_turns"] += 1
                    turns.update(f"{role}\n{content}\n".encode())
                for s, e in zip(p["loss_starts"], p["loss_ends"], strict=True):
                    masked = unescape(text[s:e])
                    row["loss_chars"] += len(masked)
                    loss.update(masked.encode())
                row["formatted_chars"] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if row is not None:
            yield pa.RecordBatch.from_pylist([done()], arrow)

    arrow = pa.schema([(x, pa.string() if "sha" in x else pa.int64()) for x in names])
    return parts.mapInArrow(run, schema)
