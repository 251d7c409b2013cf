"""Near duplicates by SimHash fingerprints of word shingles.

Two fingerprints of 64 bits that differ in at most ``MAX_BITS`` = 2 bits agree in at least six of
their eight bytes, place by place. The index posts each *distinct* fingerprint under its positional
bytes. A list for one positional byte would hold 1/256 of all fingerprints and meet quadratically many
others, so a posting names six places and their bytes, and the key stands for the tally of shared bytes:
two fingerprints are in such a list together exactly if that tally reaches the guaranteed minimum of six.
Within a list only the two other bytes are free, so it has at most 65,536 members however many documents
there are. A list verifies which members differ in so few bits, then reports a star per linked group, one
row for each member: no pair of a large group is ever written out.

Cases: texts of one or two words are one shingle; texts without a word (null, empty, white space) have
fingerprint zero and are linked like any other. Rows with a null id get a fingerprint and a component;
the component's id is the smallest non-null id in it, null if it has none. Repeated rows and ids appear as
often as they came. An empty table gives an empty result. Other columns are ignored by ``near_duplicates``
and kept by ``keep_one``. Long texts are hashed in pieces, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .common import map_batches
from .components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Shingles whose bits are counted at once.
PIECE = 1 << 15
#: The pairs of byte places that a posting leaves free.
FREE = list(combinations(range(8), 2))


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or b"").lower().split()  # on bytes both know A-Z and the six white characters only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, n, PIECE):
        part = words[start : min(start + PIECE, n) + width - 1]
        if len(part) < width:
            shingles: Iterator[bytes] = iter([b" ".join(part)])
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``bits``, the fingerprint as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t.as_py()) for t in batch.column(1)]
        bits = np.array(found, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["id", "bits"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return map_batches(slim, rows, f"id {kind}, bits long").withColumnRenamed("id", id_col)


def _roots(parts: np.ndarray) -> np.ndarray:
    """For 16-bit values of one list: the place of the smallest-placed value linked to each."""
    n = len(parts)
    flips = [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]
    place = np.full(1 << 16, -1, dtype=np.int64)
    place[parts] = np.arange(n)
    ends = []
    for flip in flips:
        other = place[parts ^ flip]
        here = np.nonzero(other >= 0)[0]
        ends.append((here, other[here]))
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def _stars(keys: np.ndarray, free: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (member, root) of all complete lists; rows come sorted by list, then fingerprint."""
    starts = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]) | (free[1:] != free[:-1])])[0]
    sizes = np.diff(np.r_[starts, len(keys)])
    twos = starts[sizes == 2]
    differ = np.bitwise_count((bits[twos] ^ bits[twos + 1]).view(np.uint64))
    close = twos[differ <= MAX_BITS]
    yield bits[close + 1], bits[close]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        own = bits[start : start + size].view(np.uint64)
        a, b = FREE[free[start]]
        parts = ((own >> np.uint64(8 * a)) & np.uint64(255)) | (
            ((own >> np.uint64(8 * b)) & np.uint64(255)) << np.uint64(8)
        )
        root = _roots(parts.astype(np.int64))
        linked = np.nonzero(root != np.arange(size))[0]
        yield own[linked].view(np.int64), own[root[linked]].view(np.int64)


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links that join all distinct fingerprints (column bits) within ``MAX_BITS``."""

    def posting(i: int, a: int, b: int) -> Column:
        mask = ~((255 << 8 * a) | (255 << 8 * b))
        mask = (mask & (1 << 64) - 1) - (mask & 1 << 63) * 2
        return F.struct(F.lit(i).alias("free"), F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("key"))

    postings = prints.select(
        "bits", F.inline(F.array(*[posting(i, a, b) for i, (a, b) in enumerate(FREE)]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            free, key, bits = rows
            if not len(key):
                continue
            # The last list may go on in the next batch; it has 65,536 members at most.
            cut = len(key) - int(np.argmax(((key != key[-1]) | (free != free[-1]))[::-1]))
            if key[0] == key[-1] and free[0] == free[-1]:
                cut = 0
            rest = [x[cut:] for x in rows]
            if cut:
                yield from out(_stars(key[:cut], free[:cut], bits[:cut]))
        if rest is not None and len(rest[0]):
            yield from out(_stars(rest[1], rest[0], rest[2]))

    def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pairs = list(found)
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    lists = postings.select("free", "key", "bits").repartition("free", "key")
    return lists.sortWithinPartitions("free", "key", "bits").mapInArrow(run, "u long, v long")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and per distinct fingerprint its component's root."""
    rows = stage_table(with_fingerprint(docs, id_col, text_col), "fingerprints")
    prints = stage_table(rows.groupBy("bits").agg(F.min(id_col).alias("first")), "distinct")
    roots = components(links(prints.select("bits")))
    rooted = prints.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    return rows, stage_table(rooted, "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id."""
    rows, rooted = _numbered(docs, id_col, text_col)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("bits", "component_id")
    return rows.join(named, "bits").select(
        id_col, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near duplicates.

    Of a group the row with the smallest id stays (null ids last, then the smaller text hash; of
    rows equal in both one stays). Only ids and hashes are compared; the texts stay where they are.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    order = F.struct(
        ident.isNull().alias("none"), ident.alias("id"), F.xxhash64(ident, text).alias("hash")
    )
    _, rooted = _numbered(docs.select(order.alias("order"), text.alias("text")), "order", "text")
    best = rooted.groupBy("root").agg(F.min("first").alias("order")).select("order")
    # The row travels as one value, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order.alias("order"))
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("order").orderBy(F.lit(0)))).filter("nth = 1")
    return once.join(best, "order", "left_semi").select("row.*")
