"""SentencePiece encoding and decoding: streaming Viterbi.

The lattice holds, for every position of a text, the pieces that end there. The public model is of the BPE kind, so a
path is not ranked by a sum of scores: an edge survives when the piece and the one before it are what merging by score
leaves of the two together. Under merging by score exactly one path survives at each position, so the result equals the
model's own. Only a window of the longest piece's length is live; ids are committed whenever the backpointer paths of
all positions in the window meet on one boundary. Spaces open a piece and are never inside one, and a character that no
piece contains cannot be merged, so the paths always meet there; units between such places are remembered by a worker.

Defined results: a null or empty text has no ids and decodes to the empty text; a text that contains U+2581 decodes
with a space in its place, as the model defines; repeated rows are encoded alike; columns other than id and text are
never read; very long units are encoded in the same bounded window.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.common import UnitIds, bound_batches, in_slices

SPACE = "▁"
#: Put between units; the rare texts that have it themselves are cut by the pattern instead.
CUT = "\x01"
LETTERS = "".join(c for c in map(chr, range(65, 592)) if c.isalpha())
#: A run of spaces with what follows it, a newline, or what follows a newline. No piece contains a newline.
UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
#: Units of at most so many characters fit one window; longer ones are streamed.
WINDOW_CHARS = 48
#: What a worker remembers: ids of units, lattices of prefixes of each ``PREFIX``-th length,
#: verdicts on pairs of pieces, halves of pieces; each with a bound in bytes.
PREFIX = 4
UNIT_BYTES, PREFIX_BYTES, PAIR_BYTES, SPLIT_BYTES = 40 << 20, 24 << 20, 16 << 20, 8 << 20
#: Positions between two attempts to commit.
COMMIT_EVERY = 64


class Remembered(dict):
    """A dictionary that is emptied where it would hold more than so many bytes, by the sizes of its entries as given."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.held = limit, 0

    def put(self, key: object, value: object, size: int) -> None:
        if self.held + size > self.limit:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size


class PieceModel:
    """Pieces, scores and byte ids of a SentencePiece file of the BPE kind."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        self.normal = {x: i for i, x in enumerate(names) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
        self.score = [p.get_score(i) for i in range(n)]
        scores = sorted({-self.score[i] for i in self.normal.values()})
        order = {x: k for k, x in enumerate(scores)}
        self.place = {x: order[-self.score[i]] for x, i in self.normal.items()}
        self.longest = max(map(len, self.normal))
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = p.unk_id()
        self.bytes = [x.encode() for x in names]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        for i in range(n):
            if p.is_control(i):
                self.bytes[i] = b""
        self.names = names
        self.lengths = list(map(len, names))
        self.pairs, self.prefixes, self.split = map(Remembered, (PAIR_BYTES, PREFIX_BYTES, SPLIT_BYTES))
        self.ids = UnitIds(self._learn, CUT, UNIT_BYTES, np.int32)
        self.alphabet = set("".join(self.normal))
        inner = {x[i : i + 2] for x in self.normal for i in range(len(x) - 1)}
        #: Marks that no piece has behind a Latin letter: the lattice always meets between the two.
        self.marks = "".join(c for c in ".,;:!?" if not any(x + c in inner for x in LETTERS))

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Merging by score of a short text, the leftmost of equals first, down to ``stop`` parts: what defines the edges."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.normal.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def rank(self, piece: str) -> int:
        """When merging makes a piece: its place by score, or -1 for a single character, which is there from the start."""
        return self.place[piece] if len(piece) > 1 else -1

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge makes a piece."""
        found = self.split.get(piece)
        if found is None:
            found = tuple(self.merged(piece, 2))
            self.split.put(piece, found, 400)
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging by score leaves ``left`` and ``right`` side by side.

        Undo their merges from the latest on: the boundary holds unless at some point a merge across it would have come
        before the one just undone. Of equal merges the left one comes first.
        """
        place, limit = self.place, 1 << 60
        while True:
            across = place.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = self.rank(left), self.rank(right)
            if a > b:
                limit, left = a, self.halves(left)[1]
            elif b >= 0:
                limit, right = b + 1, self.halves(right)[0]
            else:
                return True

    def follows(self, left: str | None, piece: str) -> bool:
        """Whether ``piece`` may stand after ``left`` (None: at the start of a unit)."""
        if left is None:
            return len(piece) == 1 or self.merged(piece) == [piece]
        return self.compatible(left, piece)

    def ids_of(self, piece: str) -> list[int]:
        i = self.normal.get(piece)
        if i is not None:
            return [i]
        ids = [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
        return ids if min(ids) > self.unknown else [self.unknown]

    def viterbi(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Committed runs of ids for a stream of characters; keeps a window of the longest piece's length."""
        window = ""  # characters since the last committed boundary
        last: list[str | None] = [None]  # the piece that ends at each position of the window
        for c in chars:
            window += c
            i = len(window)
            found = None
            for k in range(max(0, i - self.longest), i):
                piece = window[k:]
                if (len(piece) == 1 or piece in self.normal) and self.follows(last[k], piece):
                    found = piece
                    break
            if found is None:
                raise AssertionError(f"no path reaches position {i}")
            last.append(found)
            if i >= self.longest + COMMIT_EVERY:
                # Walk back from every live position; the largest boundary on all of their paths is committed.
                common: set[int] | None = None
                for j in range(i - self.longest + 1, i + 1):
                    path = {j}
                    while j:
                        j -= len(last[j])
                        path.add(j)
                    common = path if common is None else common & path
                b = max(common)
                if b:
                    yield self._back(last, b)
                    window, last = window[b:], last[b:]
        if window:
            yield self._back(last, len(window))

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a unit that fits the window: the same lattice without the stream, over ids.

        A character that no piece contains stands as a negative number. The lattice of a prefix is that of every unit
        which begins so: those of each fourth length are remembered.
        """
        n, longest, known, pairs, prefixes = len(text), self.longest, self.normal, self.pairs, self.prefixes
        last, done = [-1], 0
        for m in range((n - 1) // PREFIX * PREFIX, 0, -PREFIX):
            found = prefixes.get(text[:m])
            if found is not None:
                last, done = list(found), m
                break
        for i in range(done + 1, n + 1):
            for k in range(i - 1, (i - longest if i > longest else 0) - 1, -1):
                part = text[k:i]
                if part in known:
                    piece = known[part]
                elif k < i - 1:
                    continue
                else:
                    piece = -2 - ord(part)
                key = last[k] * 0x400000 + piece
                ok = pairs.get(key)
                if ok is None:
                    ok = self.follows(None if last[k] == -1 else self._name(last[k]), self._name(piece))
                    pairs.put(key, ok, 140)
                if ok:
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no path reaches position {i}")
            if not i % PREFIX and i < n:
                prefixes.put(text[:i], tuple(last), 250 + 40 * i)
        out, lengths = [], self.lengths
        while n:
            piece = last[n]
            if piece >= 0:
                out.append(piece)
                n -= lengths[piece]
            else:
                out += reversed(self.ids_of(self._name(piece)))
                n -= 1
        out.reverse()
        return tuple(out)  # a tuple of numbers, which the garbage collector need not follow

    def _name(self, piece: int) -> str:
        return self.names[piece] if piece >= 0 else chr(-2 - piece)

    def _back(self, last: list[str | None], end: int) -> list[int]:
        pieces = []
        while end:
            pieces.append(last[end])
            end -= len(last[end])
        return [x for p in reversed(pieces) for x in self.ids_of(p)]

    def _learn(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The ids of units: in one lattice where they fit the window, else by the stream."""
        found = [self.unit(u) if len(u) <= WINDOW_CHARS else tuple(chain.from_iterable(self.viterbi(u))) for u in units]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return units, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every whole text of an array without nulls."""
        own = pc.replace_substring(texts, " ", SPACE)
        # A space is put before every text that is not empty; then every place where the lattice must meet is cut.
        own = pc.if_else(pc.equal(own, ""), own, pc.binary_join_element_wise(SPACE, own, ""))
        cut = pc.replace_substring_regex(pc.replace_substring(own, "\n", f"{CUT}\n{CUT}"), f"({SPACE}+)", f"{CUT}\\1")
        if self.marks:
            cut = pc.replace_substring_regex(cut, f"([{LETTERS}])([{self.marks}])", f"\\1{CUT}\\2")
        joined, sizes = self.ids(pc.split_pattern(cut, CUT))
        out = np.split(joined, np.cumsum(sizes)[:-1]) if len(sizes) else []
        for i in np.flatnonzero(pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False)):
            out[i] = self._learn(UNIT.findall(own[int(i)].as_py()))[1]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: pieces joined, byte pieces put together, the space added at the start removed."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def load(model_file: str) -> PieceModel:
    """The model, read once by each worker."""
    if model_file not in _models:
        m = _models[model_file] = PieceModel(model_file)
        if "\n" in m.alphabet or any(SPACE in x.lstrip(SPACE) for x in m.normal):
            raise ValueError("a model whose pieces hold a newline or an inner space")
    return _models[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, ids array<int>, n_tokens, ids_crc32, n_chars, round_trip)``: ``round_trip`` tells whether decoding gives the text again."""
    bound_batches(docs.sparkSession)
    src = docs.select(id_col, text_col)
    schema = T.StructType([
        src.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("round_trip", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for b in batches:
            filled = pc.fill_null(b.column(1), "")
            texts, arrays = filled.to_pylist(), model.encode(filled)
            back = [model.decode(a.tolist()) == x for a, x in zip(arrays, texts, strict=True)]
            offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))
            crcs = [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(back, pa.bool_())],
                [id_col, "ids", "n_tokens", "ids_crc32", "n_chars", "round_trip"],
            )

    return src.mapInArrow(in_slices(run, 1), schema)
