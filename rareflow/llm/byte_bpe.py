"""Byte-level byte-pair encoding and decoding with a public rank file, without regular expressions.

Pre-tokenisation is a scan. Every code point has a class (letter, digit, space, ...); a class is a function on
the eight states of a small automaton, and whether a slice starts at a code point follows from the state before
it and its class. Functions compose associatively and their compositions are few, so they are numbered once and
a prefix scan over these numbers, block by block and all blocks side by side, gives the state before every code
point of many texts at a time. What the pattern looks ahead for (what follows white space or an apostrophe) is
part of the class. Slices of the UTF-8 bytes are merged by rank once per distinct slice and remembered.

Ids come with ``offsets``, the byte at which each begins, so any byte range is decoded from its own ids only.
A long text is scanned in parts, cut before white space that follows something else, where a slice starts
whatever comes before; a slice of any length is merged in n log n steps. Rank file and classes have a fixed
size and are broadcast; a task remembers ``MEMO_SLICES`` slices.

Cases: a null text is empty; an empty one has no ids and decodes to no bytes. Rows with null or repeated ids are
encoded like any other; an empty table gives an empty result; other columns are ignored. Code points that no
Unicode version up to this Python's assigns count as neither letter nor digit.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

#: Code points that are scanned at once.
CHUNK = 1 << 20
#: Slices a task remembers, and the bytes of the longest of them.
MEMO_SLICES = 1 << 19
MEMO_BYTES = 128
#: Above every rank.
NONE = 1 << 32
#: Steps of a block in the scan.
BLOCK = 64

#: Classes: letter, digit, anything else; apostrophe of a contraction with one or two letters; white space that
#: more white space or the end follows; a space, and other white space, before something else; end of a text.
LETTER, DIGIT, OTHER, SHORT, LONG, WHITE, SPACE, GAP, END = range(9)
#: States: nothing open; in letters, digits, others; after a space that belongs to what follows; in white
#: space; two letters and one letter of a contraction to come.
FRESH, LETTERS, DIGITS, OTHERS, PREFIX, WHITES, TWO, ONE = range(8)
#: White space of the pattern (fixed values).
WHITE_POINTS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters of contractions (fixed values).
SHORT_ENDS = "stmd"
LONG_ENDS = ["re", "ve", "ll"]
#: Stands for the end of a text among code points.
END_POINT = 0x110000


def point_classes() -> bytes:
    """The class of each code point by itself, packed."""
    kinds = np.full(END_POINT + 1, OTHER, dtype=np.uint8)
    first = [unicodedata.category(chr(c))[0] for c in range(END_POINT)]
    first_letters = np.array(first)
    kinds[:-1][first_letters == "L"] = LETTER
    kinds[:-1][first_letters == "N"] = DIGIT
    kinds[WHITE_POINTS] = WHITE
    kinds[END_POINT] = END
    return zlib.compress(kinds.tobytes())


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a slice starts at it."""
    if kind == END:
        return FRESH, True
    if kind == WHITE:
        return WHITES, state != WHITES
    if kind == SPACE:
        return PREFIX, True
    if kind == GAP:
        return FRESH, True
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FRESH, False
    inside = {LETTER: LETTERS, DIGIT: DIGITS}.get(kind, OTHERS)
    if state in (PREFIX, inside):
        return inside, False
    if kind == SHORT:
        return ONE, True
    if kind == LONG:
        return TWO, True
    return inside, True


class Scanner:
    """Slice boundaries of code points."""

    def __init__(self, packed_classes: bytes):
        self.kinds = np.frombuffer(zlib.decompress(packed_classes), dtype=np.uint8)
        steps = [[_step(s, k) for k in range(END + 1)] for s in range(ONE + 1)]
        self.starts = np.array([[start for _, start in row] for row in steps])
        identity = tuple(range(ONE + 1))
        classes = [tuple(steps[s][k][0] for s in identity) for k in range(END + 1)]
        numbers = {identity: 0}
        found = [identity]
        for f in found:  # grows while it is read
            for c in classes:
                made = tuple(c[s] for s in f)
                if made not in numbers:
                    numbers[made] = len(found)
                    found.append(made)
        self.size = len(found)
        self.of_class = np.array([numbers[c] for c in classes], dtype=np.int32)
        self.composed = np.array([numbers[tuple(g[s] for s in f)] for f in found for g in found], dtype=np.int32)
        self.from_fresh = np.array([f[FRESH] for f in found], dtype=np.uint8)

    def composition(self, f: np.ndarray) -> np.ndarray:
        """The composition of all functions up to each place."""
        n = len(f)
        rows = -(-n // BLOCK)
        grid = np.zeros(rows * BLOCK, dtype=np.int32)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
        for t in range(1, BLOCK):
            grid[t] = self.composed[grid[t - 1] * self.size + grid[t]]
        if rows > 1:
            carried = self.composition(grid[-1, :-1])
            grid[:, 1:] = self.composed[carried * self.size + grid[:, 1:]]
        return grid.T.reshape(-1)[:n]

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes with what follows; the last point is the end of a text."""
        kinds = self.kinds[points]
        after = np.r_[kinds[1:], np.uint8(END)]
        last = (kinds == WHITE) & (after != WHITE) & (after != END)
        kinds[last] = np.where(points[last] == 32, SPACE, GAP)
        marks = np.flatnonzero(points == ord("'"))
        one = points[np.minimum(marks + 1, len(points) - 1)]
        two = points[np.minimum(marks + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in SHORT_ENDS])
        long = np.zeros(len(marks), dtype=bool)
        for a, b in LONG_ENDS:
            long |= (one == ord(a)) & (two == ord(b))
        kinds[marks[short]], kinds[marks[long]] = SHORT, LONG
        return kinds

    def boundaries(self, points: np.ndarray) -> np.ndarray:
        """Places at which a slice starts or a text ends."""
        kinds = self.classes(points)
        before = np.r_[np.uint8(FRESH), self.from_fresh[self.composition(self.of_class[kinds])][:-1]]
        return np.flatnonzero(self.starts[before, kinds])

    def slices(self, texts: list[str]) -> Iterator[list[bytes]]:
        """The UTF-8 slices of each text."""
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = END_POINT
        marks = self.boundaries(points)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + ((points > 0xFFFF) & (points < END_POINT))
        widths[ends] = 1
        at = (np.cumsum(widths) - widths)[marks].tolist()
        raw = joined.encode("utf-8", "surrogatepass")
        begin = 0
        for stop in np.searchsorted(marks, ends).tolist():
            yield [raw[a:b] for a, b in zip(at[begin:stop], at[begin + 1 : stop + 1], strict=True)]
            begin = stop + 1


def parts(text: str) -> Iterator[str]:
    """A text in parts of about ``CHUNK`` that are sliced as the whole is."""
    start, size = 0, CHUNK
    while len(text) - start > size:
        at = text.rfind(" ", start + 1, start + size)
        while at > start and text[at - 1].isspace():
            at = text.rfind(" ", start + 1, at)
        if at <= start:
            size *= 2
            continue
        yield text[start:at]
        start, size = at, CHUNK
    yield text[start:]


class Pairs(dict):
    """The rank of two ids together, ``NONE`` if they never merge; remembered."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]):
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, ids: tuple[int, int]) -> int:
        rank = self[ids] = self.ranks.get(self.tokens[ids[0]] + self.tokens[ids[1]], NONE)
        return rank


class Coder:
    """Encoding and decoding in one task."""

    def __init__(self, ranks: dict[bytes, int], packed_classes: bytes):
        self.ranks, self.scanner = ranks, Scanner(packed_classes)
        self.longest = max(map(len, ranks), default=0)
        size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.bytes = [ranks.get(bytes([b]), NONE) for b in range(256)]
        self.memo: dict[bytes, bytes] = {}
        self.pairs = Pairs(ranks, self.tokens)

    def merged(self, piece: bytes) -> bytes:
        """Ids of a slice: the adjacent parts of lowest rank merge first, the leftmost of equals."""
        if len(piece) > MEMO_BYTES:
            return self.merged_long(piece)
        pairs = self.pairs
        ids = [self.bytes[b] for b in piece]
        ranks = [pairs[x] for x in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pairs[low, ids[i + 1]]
            if i:
                ranks[i - 1] = pairs[ids[i - 1], low]
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged_long(self, piece: bytes) -> bytes:
        """The same by a heap of pairs, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = []

        def offer(i: int) -> None:
            end = after[after[i]]
            if end - i <= self.longest:
                rank = ranks.get(piece[i:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            # Something else may have taken a part of this pair since.
            if after[i] >= end or after[after[i]] != end:
                continue
            gone = after[i]
            after[gone] = n + 1
            after[i] = end
            if end < n:
                before[end] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(out, dtype="<u4").tobytes()

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.memo) > MEMO_SLICES:
            self.memo.clear()
            self.pairs.clear()
        sliced = list(self.scanner.slices(texts))
        long: dict[bytes, bytes] = {}
        for piece in set().union(*sliced) - self.memo.keys():
            (self.memo if len(piece) <= MEMO_BYTES else long)[piece] = self.merged(piece)
        known = {**self.memo, **long} if long else self.memo
        for pieces in sliced:
            yield b"".join(map(known.__getitem__, pieces))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        held: list[str] = []
        counts: list[int] = []
        size = 0

        def out() -> Iterator[bytes]:
            made = self._ids(held)
            for n in counts:
                yield b"".join([next(made) for _ in range(n)])

        for text in texts:
            own = list(parts(text or ""))
            if held and size + len(text or "") > CHUNK:
                yield from out()
                held, counts, size = [], [], 0
            if len(own) > 1:
                yield b"".join([next(self._ids([p])) for p in own])
                continue
            held += own
            counts.append(1)
            size += len(own[0])
        yield from out()

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each id begins."""
        widths = self.lengths[np.frombuffer(ids, dtype="<u4")]
        return np.cumsum(widths) - widths

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode_range(self, ids: bytes, offsets: np.ndarray, begin: int, end: int) -> bytes:
        """Bytes begin..end (exclusive) of the text, from the ids that hold them."""
        first = max(0, int(np.searchsorted(offsets, begin, "right")) - 1)
        last = int(np.searchsorted(offsets, end, "left"))
        if first >= last:
            return b""
        at = int(offsets[first])
        return self.decode(ids[4 * first : 4 * last])[max(0, begin - at) : max(0, end - at)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _over(docs: DataFrame, path: str, id_col: str, columns: list[str], rows, schema: str) -> DataFrame:
    """Batches of (id, *columns) through one coder per task; ``rows`` makes the new columns."""
    shared = Shared(docs.sparkSession, (read_ranks(path), point_classes()))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(*shared.value)
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                made = rows(coder, *piece.columns[1:])
                yield pa.RecordBatch.from_arrays([piece.column(0), *made], ["id", *[f"c{i}" for i in range(len(made))]])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids`` and ``offsets`` (binary, little-endian unsigned numbers of 32 bits)."""

    def rows(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        ids = list(coder.encode(texts.to_pylist()))
        at = [coder.offsets(x).astype("<u4").tobytes() for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(at, pa.binary())]

    made = _over(docs, path, id_col, [text_col], rows, "c0 long, c1 binary, c2 binary")
    return made.toDF(id_col, "n_tokens", "ids", "offsets")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", begin: int = 0, end: int | None = None) -> DataFrame:
    """id and ``decoded``: the bytes of ``encode``'s rows, or those from ``begin`` to ``end``; null ids have none."""

    def rows(coder: Coder, ids: pa.Array, offsets: pa.Array) -> list[pa.Array]:
        found = []
        for own, at in zip(ids.to_pylist(), offsets.to_pylist(), strict=True):
            own = own or b""
            if begin == 0 and end is None:
                found.append(coder.decode(own))
            else:
                places = np.frombuffer(at or b"", dtype="<u4")
                found.append(coder.decode_range(own, places, begin, 1 << 32 if end is None else end))
        return [pa.array(found, pa.binary())]

    return _over(encoded, path, id_col, ["ids", "offsets"], rows, "c0 binary").toDF(id_col, "decoded")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens and the digests of ids and decoded bytes."""

    def rows(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        counts, of_ids, of_bytes = [], [], []
        for ids in coder.encode(texts.to_pylist()):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    made = _over(docs, path, id_col, [text_col], rows, "c0 long, c1 string, c2 string")
    return made.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
