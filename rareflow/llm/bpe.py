"""Byte-pair encoding and decoding with a public vocabulary.

Words are what white space separates in the normalised text. A first pass counts them over all
documents and compiles the frequent ones, with their ids, into a transducer (``lexicon``) that every
host maps into memory. A second pass looks each distinct word up there; a word that is not in it is cut
and merged by the vocabulary's merges, exactly, so the lexicon decides speed and never a result.

The counts are lossy counts (Manku and Motwani): each task drops, every ``COUNT_EVERY`` words, entries
that cannot be frequent, so memory is bounded and every word above that share of its task survives. The
lexicon holds ``LEXICON_WORDS`` words at most; that and the vocabulary bound what is broadcast.

Cases: a null text is empty; an empty one has no ids and decodes to the empty text. Special tokens written
in a text become their ids, as the tokenizers library does by default. Rows with null or repeated ids are
encoded like any other; an empty table gives an empty result; other columns are ignored. Code points that
no Unicode version up to 15.1 assigns may be cut differently from the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared
from .lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 1 << 16
COUNT_EVERY = 1 << 20
#: Words a task remembers before it starts afresh, and words looked up at once.
MEMO_WORDS = 1 << 19
CHUNK_WORDS = 1 << 17
NONE = np.iinfo(np.int32).max
#: Pieces of more bytes are merged one by one.
LONG_BYTES = 4096
#: Control characters that str.split takes for white space and the vocabulary's rule does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"[^\s]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The vocabulary's tables; small and of fixed size, so they are broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocab = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        end = told["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int32)
        self.size = max(*vocab.values(), *self.special.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in told["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.pairs: dict[int, tuple[int, int]] = {}
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if they never merge or one is missing (negative)."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers.

        The pair of lowest rank merges first, the leftmost of equals. Pieces of like length are
        merged side by side, one merge in each per step; longer ones by a heap of their pairs.
        """
        out = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        for i in np.nonzero(lengths > LONG_BYTES)[0].tolist():
            out[i] = self._long(pieces[i])
        lengths[lengths > LONG_BYTES] = 0
        low = 0
        while low < lengths.max(initial=0):
            high = max(8, low * 2)
            chosen = np.nonzero((lengths > low) & (lengths <= high))[0].tolist()
            step = max(1, (1 << 20) // high)
            for start in range(0, len(chosen), step):
                part = chosen[start : start + step]
                made = self._side_by_side([pieces[i] for i in part])
                ends = (4 * np.cumsum((made >= 0).sum(axis=1))).tolist()
                flat = made[made >= 0].astype("<u4").tobytes()
                begin = 0
                for i, end in zip(part, ends, strict=True):
                    out[i] = flat[begin:end]
                    begin = end
            low = high
        return out

    def _long(self, piece: bytes) -> bytes:
        """One piece in n log n steps."""
        if not self.pairs:
            self.pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made[self.rank].tolist(), strict=True), strict=True))
        n = len(piece)
        ids = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        ids[-1] = int(self.last[piece[-1]])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                found = self.pairs.get(ids[i] * self.size + ids[after[i]])
                if found is not None:
                    heap.append((found[0], i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            gone = after[i]
            # An id of the pair may have merged with another since.
            if ids[i] != a or gone < 0 or ids[gone] != b:
                continue
            ids[i], ids[gone] = self.pairs[a * self.size + b][1], -1
            after[i] = after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for place in (i, before[i]):
                size = len(heap)
                offer(place)
                if len(heap) > size:
                    heapq.heappush(heap, heap.pop())
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def _side_by_side(self, pieces: list[bytes]) -> np.ndarray:
        """One row of ids per piece, filled up with -1."""
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.inner[raw], -1).astype(np.int32)
        ids[np.arange(n), lengths - 1] = self.last[raw[np.arange(n), lengths - 1]]
        ranks = np.full((n, width), NONE, dtype=np.int32)
        ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        done = ids.copy()
        alive = np.arange(n)
        while len(alive):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(alive)), at]
            go = best != NONE
            done[alive[~go]] = ids[~go]
            alive, ids, ranks, at, best = alive[go], ids[go], ranks[go], at[go], best[go]
            if not len(alive):
                break
            rows = np.arange(len(alive))
            # Take the pair's second id out of the row, then write the merged id over the first.
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[rows, at] = self.made[best]
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            ranks[rows, at] = np.where(at < width - 1, self.ranks(ids[rows, at], ids[rows, right]), NONE)
            ranks[rows, left] = np.where(at > 0, self.ranks(ids[rows, left], ids[rows, at]), ranks[rows, left])
        return done


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is like any other)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def split_words(text: str) -> list[str]:
    return WHITE.findall(text) if SEPARATORS.search(text) else text.split()


class Encoder:
    """Encoding and decoding in one task."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None = None):
        self.merges, self.lexicon = merges, lexicon
        self.pieces = regex.compile(merges.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")
        self.memo: dict[str, bytes] = {}

    def parts(self, text: str | None) -> list[str | int]:
        """Normalised words, and ids of special tokens, in order."""
        text = text or ""
        found: list[str | int] = []
        start = 0
        if "<|" in text:
            for hit in self.special.finditer(text):
                found += split_words(normalise(text[start : hit.start()]))
                found.append(self.merges.special[hit.group()])
                start = hit.end()
        found += split_words(normalise(text[start:] if start else text))
        return found

    def learn(self, words: set[str]) -> None:
        """Put words into the memo, by the lexicon or by merging."""
        if self.lexicon is not None:
            found, missing = self.lexicon.get_many(words)
            self.memo.update(found)
        else:
            missing = list(words)
        # A word of letters only is one piece; this is most words.
        whole = [w for w in missing if w.isalpha()]
        to_bytes = lambda w: w.encode("utf-8", "surrogatepass")
        self.memo.update(zip(whole, self.merges.merge(list(map(to_bytes, whole))), strict=True))
        mixed = [w for w in missing if not w.isalpha()]
        cut = [self.pieces(w) for w in mixed]
        merged = iter(self.merges.merge([to_bytes(p) for c in cut for p in c]))
        for word, pieces in zip(mixed, cut, strict=True):
            self.memo[word] = b"".join([next(merged) for _ in pieces])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        chunk: list[list[str | int]] = []
        size = 0
        for text in texts:
            parts = self.parts(text)
            chunk.append(parts)
            size += len(parts)
            if size >= CHUNK_WORDS:
                yield from self._encode_chunk(chunk)
                chunk, size = [], 0
        yield from self._encode_chunk(chunk)

    def _encode_chunk(self, chunk: list[list[str | int]]) -> Iterator[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        wanted = set().union(*chunk) - self.memo.keys()
        numbers = {w for w in wanted if isinstance(w, int)}
        for i in numbers:
            self.memo[i] = int(i).to_bytes(4, "little")  # type: ignore[index]
        self.learn(wanted - numbers)
        get = self.memo.__getitem__
        for parts in chunk:
            yield b"".join(map(get, parts))

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, special ones too, one space between two: the file names no decoder."""
        tokens = self.merges.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent normalised words with their counts, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        seen, floor, next_cut = 0, 0, COUNT_EVERY
        for batch in batches:
            for text in batch.column(0):
                words = split_words(normalise(text.as_py() or ""))
                counts.update(words)
                seen += len(words)
                if seen >= next_cut:
                    # An entry's count plus what it may have lost before is its upper bound.
                    floor += 1
                    next_cut = seen + COUNT_EVERY
                    counts = Counter({w: n for w, n in counts.items() if n > floor})
        kept = [(w, n) for w, n in counts.items() if n > floor + 1]
        words = pa.array([w for w, _ in kept], pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col)).mapInArrow(run, "word string, n long")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return total.orderBy(F.desc("n"), "word").limit(most)


def train_lexicon(docs: DataFrame, merges: Merges, text_col: str = "text") -> bytes:
    """The compiled lexicon; at most ``LEXICON_WORDS`` words come to the driver."""
    encoder = Encoder(merges)
    words = [r.word for r in frequent_words(docs, text_col).select("word").collect()]
    encoder.learn(set(words))
    return compile_lexicon({w.encode("utf-8", "surrogatepass"): np.frombuffer(encoder.memo[w], "<u4") for w in words})


def _shared(spark: SparkSession, docs: DataFrame, path: str, text_col: str):
    merges = Merges(path)
    content = train_lexicon(docs, merges, text_col)
    return Shared(spark, (merges, content))


def _coder(shared) -> Encoder:
    merges, content = shared.value
    return Encoder(merges, Lexicon.of(content))


def _over(slim: DataFrame, shared, columns, schema: str) -> DataFrame:
    """Batches of (id, text) through one encoder per task; ``columns`` makes the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _coder(shared)
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                made = columns(coder, piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), *made], ["id", *[f"c{i}" for i in range(len(made))]])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, {schema}")


def _slim(docs: DataFrame, id_col: str, value_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{value_col}`").alias("value"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit numbers)."""
    shared = _shared(docs.sparkSession, docs, path, text_col)

    def columns(coder: Encoder, values: pa.Array) -> list[pa.Array]:
        ids = list(coder.encode(values.to_pylist()))
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _over(_slim(docs, id_col, text_col), shared, columns, "c0 long, c1 binary").toDF(id_col, "n_tokens", "ids")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``decoded``, the text of ``ids``; null ids decode to the empty text."""
    shared = Shared(encoded.sparkSession, Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            texts = [coder.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    slim = _slim(encoded, id_col, ids_col)
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, text string").toDF(id_col, "decoded")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens and the digests of ids and decoded text."""
    shared = _shared(docs.sparkSession, docs, path, text_col)

    def columns(coder: Encoder, values: pa.Array) -> list[pa.Array]:
        counts, of_ids, of_texts = [], [], []
        for ids in coder.encode(values.to_pylist()):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_texts.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]

    made = _over(_slim(docs, id_col, text_col), shared, columns, "c0 long, c1 string, c2 string")
    return made.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
