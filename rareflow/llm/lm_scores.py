"""Cross-entropy difference of two n-gram models with one vocabulary.

The target model is counted over the documents of the target set, the background model over all documents.
Both are bigram models, mixed with their own unigrams, over the same words: every word of all documents, and one
more for what was never seen. A document's score is its loss per word under the target less that under the
background; the lower, the more it is like the target. Documents fall into two halves by a hash of their id, and
each is scored by models counted on the other half, so none is scored by its own words.

Words and pairs of words are counted exactly, whatever their number; each stands as a hash of 64 bits. Documents
are dealt to pieces of about ``PIECE_BYTES``. A piece counts its words and pairs once each and sends them, sorted
and cut into buckets by their hash, to where all pieces' counts of a bucket are added. A piece gets back only what
the *other* half of the corpus has of its words and pairs; everything else has count zero there, most pairs among
them. So texts move once, a pair moves once for each piece that holds it, and nothing is looked up row by row.

Pieces and buckets are as many as the corpus needs. Equal words and pairs are counted within the piece before they
move, so a word or pair that every document holds costs one entry for each piece. Rows of an id that many rows
share (over 1/``HOT_SHARE`` of all; fewer than ``HOT_SHARE`` ids, which alone come to the driver) and of null ids
are dealt by their text instead.

Cases: null and empty texts have no words and null losses and score; a null id is in the first half and in no
target set. Repeated rows are counted as often as they come. Without a target document the target model is
uniform. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Weight of the bigram estimate; the unigram has the rest.
BIGRAM = 0.6
HALVES = 2
#: Bytes of text in a piece and for each bucket.
PIECE_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
HOT_SHARE = 1000
#: What stands before the first word.
START = 0
#: Half and model (0 target, 1 background) of each count.
KINDS = [(half, model) for half in range(HALVES) for model in range(2)]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Hashes(dict):
    """Hash of each word of a piece."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word) or 1
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), dtype=np.uint64, count=len(words))


def word_keys(words: np.ndarray) -> np.ndarray:
    """The last bit tells words from pairs."""
    return words & ~np.uint64(1)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ words
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29)) | np.uint64(1)


def planes(numbers: np.ndarray, width: int) -> bytes:
    """Little-endian integers byte place by byte place, so that places that are mostly zero compress well."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def of_planes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, compressed; the first byte is their width."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + zlib.compress(planes(numbers, width), 1)


def unpacked(data: bytes) -> np.ndarray:
    return of_planes(zlib.decompress(data[1:]), data[0]).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them; the shuffle's own compression takes the empty places out."""
    return planes(np.diff(keys, prepend=np.uint64(0)), 8)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(of_planes(data, 8), dtype=np.uint64)


class Piece:
    """Words and pairs of some documents."""

    def __init__(self, texts: list[bytes | None], halves: list[int], targets: list[bool], buckets: int):
        known = Hashes()
        found = [known.of(words_of(t)) for t in texts]
        self.lengths = np.array([len(x) for x in found], dtype=np.int64)
        words = np.concatenate([*found, np.zeros(0, np.uint64)])
        first = np.cumsum(self.lengths) - self.lengths
        before = np.r_[np.uint64(START), words[:-1]] if len(words) else words
        self.starts = np.zeros(len(words), dtype=bool)
        self.starts[first[self.lengths > 0]] = True
        before = np.where(self.starts, np.uint64(START), before)
        keys = np.concatenate([word_keys(words), pair_keys(before, words)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.word, self.pair = at[: len(words)], at[len(words) :]
        self.before = np.r_[0, self.word[:-1]] if len(words) else self.word
        self.half = np.repeat(np.array(halves, dtype=np.int64), self.lengths)
        self.target = np.repeat(np.array(targets, dtype=bool), self.lengths)
        # Buckets are ranges of the key, so each is one stretch of the sorted keys.
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.buckets, self.begins = np.unique(bucket.astype(np.int64), return_index=True)
        self.ends = np.r_[self.begins[1:], len(self.keys)]

    def counts(self) -> np.ndarray:
        """(kind, key): how often each key stands."""
        out = []
        for half, model in KINDS:
            own = (self.half == half) & (self.target if model == 0 else True)
            out.append(sum(np.bincount(at[own], minlength=len(self.keys)) for at in (self.word, self.pair)))
        return np.array(out, dtype=np.int64).reshape(len(KINDS), len(self.keys))

    def asked(self) -> np.ndarray:
        """Per key: bit h is set if a document of half h holds it."""
        out = np.zeros(len(self.keys), dtype=np.int64)
        for half in range(HALVES):
            own = self.half == half
            for at in (self.word, self.pair):
                out[at[own]] |= 1 << half
        return out

    def losses(self, counts: np.ndarray, totals: np.ndarray, size: int) -> list[tuple[float | None, float | None]]:
        """Mean loss of each document under the target and the background model of the other half."""
        sums = []
        for model in range(2):
            kind = 2 * (1 - self.half) + model
            total = totals[kind]
            alone = (counts[kind, self.word] + 1.0) / (total + size)
            seen = np.where(self.starts, total, counts[kind, self.before])
            together = np.where(seen > 0, counts[kind, self.pair] / np.maximum(seen, 1), alone)
            own = np.r_[0.0, np.cumsum(-np.log(BIGRAM * together + (1 - BIGRAM) * alone))]
            ends = np.cumsum(self.lengths)
            sums.append(own[ends] - own[ends - self.lengths])
        return [
            (float(t / n), float(b / n)) if n else (None, None)
            for t, b, n in zip(sums[0], sums[1], self.lengths.tolist(), strict=True)
        ]


@dataclass
class Models:
    """The documents that both models are counted on, and what says which belong to the target set.

    They are counted by the job that scores, which sends each piece only the counts it needs.
    """

    docs: DataFrame
    target: Column | DataFrame
    id_col: str
    text_col: str


def train(docs: DataFrame, target: Column | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """``target`` is a condition on the rows of ``docs`` or a table with their ids in its first column."""
    return Models(docs, target, id_col, text_col)


def _half(id_col: str) -> Column:
    return F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(HALVES)).cast("int")


def _dealt(docs: DataFrame, id_col: str, text_col: str, target: Column | DataFrame | None, trains: bool, asks: bool) -> tuple[DataFrame, int]:
    """piece, id, half, text, target, kind (0 a target id, 1 a document) and the number of bytes.

    ``trains`` and ``asks`` are what the piece is for; they are part of its number, so that pieces differ.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")
    bytes_, rows = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.count(F.lit(1))).first()
    pieces = max(1, -(-(bytes_ or 0) // PIECE_BYTES))
    hot: list = []
    by_ids = isinstance(target, DataFrame)
    if rows:
        often = docs.select(ident.alias("id")).groupBy("id").count().filter(F.col("count") > max(1000, rows // HOT_SHARE))
        hot = [r.id for r in often.filter("id is not null").collect()]
    spread = ident.isNull()
    if hot:
        spread = spread | ident.isin(hot)
    # Equal rows of different parts of the table part, too.
    place = F.when(spread, F.xxhash64(ident, text, F.spark_partition_id())).otherwise(F.xxhash64(ident))
    place = F.pmod(place, F.lit(pieces)) * 4 + F.lit(2 * trains + asks)
    own = F.lit(False) if target is None or by_ids else F.coalesce(target, F.lit(False))
    if by_ids:
        ids = target.select(F.col(target.columns[0]).cast(docs.schema[id_col].dataType).alias("id")).filter("id is not null").distinct()
        if hot:
            own = ident.isin([r.id for r in ids.filter(F.col("id").isin(hot)).collect()])
    slim = docs.select(
        place.alias("piece"), ident.alias("id"), _half(id_col).alias("half"), text.alias("text"), F.coalesce(own, F.lit(False)).alias("target"), F.lit(1).alias("kind")
    )
    if by_ids:
        places = F.pmod(F.xxhash64("id"), F.lit(pieces)) * 4 + F.lit(2 * trains + asks)
        none = F.lit(None).cast("binary")
        slim = slim.unionByName(ids.select(places.alias("piece"), "id", F.lit(0).alias("half"), none.alias("text"), F.lit(True).alias("target"), F.lit(0).alias("kind")))
    return slim, bytes_ or 0


def _piece(table: pa.Table, buckets: int) -> tuple[Piece, pa.Table]:
    """A piece's documents, in an order that does not depend on how they came, and their words."""
    kinds = table.column("kind").to_numpy()
    listed = set(table.column("id").filter(pa.array(kinds == 0)).to_pylist())
    docs = table.filter(pa.array(kinds == 1))
    targets = [t or (i is not None and i in listed) for i, t in zip(docs.column("id").to_pylist(), docs.column("target").to_pylist(), strict=True)]
    return Piece(docs.column("text").to_pylist(), docs.column("half").to_pylist(), targets, buckets), docs


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


#: A piece's keys of a bucket with counts by kind, or with the halves that ask for them.
_SENT = "bucket long, piece long, keys binary, counts binary, asked binary, asks boolean"
#: Steps between the places of keys that the other half has, and their counts; or sums of a bucket.
_ANSWER = "piece long, at binary, counts binary, bucket long, size long, totals array<long>"


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, target_loss, background_loss and score of every document."""
    same = docs is models.docs and (id_col, text_col) == (models.id_col, models.text_col)
    slim, size = _dealt(models.docs, models.id_col, models.text_col, models.target, True, same)
    wanted = slim
    if not same:
        wanted, _ = _dealt(docs, id_col, text_col, None, False, True)
    buckets = max(1, -(-size // BUCKET_BYTES))

    sent_arrow, answer_arrow = _arrow(_SENT), _arrow(_ANSWER)

    def sent(trains: bool, asks: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            piece, _ = _piece(table, buckets)
            counts, asked = piece.counts(), piece.asked()
            rows = []
            for bucket, a, b in zip(piece.buckets.tolist(), piece.begins.tolist(), piece.ends.tolist(), strict=True):
                rows.append(
                    {
                        "bucket": bucket,
                        "piece": key[0].as_py(),
                        "keys": packed_keys(piece.keys[a:b]),
                        "counts": packed(counts[:, a:b].ravel()) if trains else None,
                        "asked": packed(asked[a:b]) if asks and not trains else None,
                        "asks": asks,
                    }
                )
            return pa.Table.from_pylist(rows, sent_arrow)

        return run

    requests = slim.groupBy("piece").applyInArrow(sent(True, same), _SENT)
    if not same:
        requests = requests.unionByName(wanted.groupBy("piece").applyInArrow(sent(False, True), _SENT))

    def answered(key: tuple, table: pa.Table) -> pa.Table:
        own = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        ends = np.cumsum([len(k) for k in own])
        places = np.split(at, ends[:-1])
        total = np.zeros((len(KINDS), len(keys)), dtype=np.int64)
        given = [unpacked(c).reshape(len(KINDS), -1) if c is not None else None for c in table.column("counts").to_pylist()]
        for place, counts in zip(places, given, strict=True):
            if counts is not None:
                total[:, place] += counts
        words = (keys & np.uint64(1)) == 0
        trained = total[1::2].sum(axis=0) > 0
        bucket = key[0].as_py()
        # One row with the bucket's sums; its piece is no document's.
        rows = [{"piece": -1 - bucket, "at": None, "counts": None, "bucket": bucket, "size": int((words & trained).sum()), "totals": total[:, words].sum(axis=1).tolist()}]
        rest = zip(places, given, table.column("asked").to_pylist(), table.column("piece").to_pylist(), table.column("asks").to_pylist(), strict=True)
        for place, counts, asked, piece, asks in rest:
            if not asks:
                continue
            halves = (counts[1] > 0) + 2 * (counts[3] > 0) if counts is not None else unpacked(asked)
            here = total[:, place]
            # Documents of one half need the counts of the other; what is zero there is not sent.
            needed = ((halves & 1 > 0) & (here[3] > 0)) | ((halves & 2 > 0) & (here[1] > 0))
            found = np.flatnonzero(needed)
            rows.append(
                {"piece": piece, "at": packed(np.diff(found, prepend=0)), "counts": packed(here[:, found].ravel()), "bucket": bucket, "size": 0, "totals": [0] * len(KINDS)}
            )
        return pa.Table.from_pylist(rows, answer_arrow)

    answers = requests.groupBy("bucket").applyInArrow(answered, _ANSWER).repartition("piece")
    # Every column is read here, so that this exchange is the one that the documents meet.
    sums = answers.agg(
        F.sum("size").alias("all_size"),
        F.array(*[F.sum(F.col("totals")[i]) for i in range(len(KINDS))]).alias("all_totals"),
        F.count(F.struct("at", "counts", "bucket")).alias("n_answers"),
    )
    told = answers.crossJoin(F.broadcast(sums))
    kind = wanted.schema["id"].dataType

    def scored(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        piece, documents = _piece(table, buckets)
        counts = np.zeros((len(KINDS), len(piece.keys)), dtype=np.int64)
        begins = dict(zip(piece.buckets.tolist(), piece.begins.tolist(), strict=True))
        for row in own.select(["bucket", "at", "counts"]).to_pylist():
            counts[:, begins[row["bucket"]] + np.cumsum(unpacked(row["at"]))] = unpacked(row["counts"]).reshape(len(KINDS), -1)
        totals, size = np.zeros(len(KINDS)), 1
        if own.num_rows:
            totals, size = np.array(own.column("all_totals")[0].as_py(), dtype=float), own.column("all_size")[0].as_py() + 1
        losses = piece.losses(counts, totals, size)
        score = [None if t is None else t - b for t, b in losses]
        columns = [documents.column("id").combine_chunks(), pa.array(piece.lengths), *(pa.array([x[i] for x in losses], pa.float64()) for i in (0, 1)), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(columns, schema=out_schema)

    schema = f"id {kind.simpleString()}, n_words long, target_loss double, background_loss double, score double"
    out_schema = _arrow(schema)
    met = wanted.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(scored, schema)
    return met.withColumnRenamed("id", id_col)

