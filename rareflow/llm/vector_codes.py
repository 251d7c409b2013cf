"""Compression of vectors to codes, one per part, with codebooks by ball k-means.

A vector's components become integers (``SCALE`` steps a unit, rounded down) and it is cut into ``PARTS`` equal
parts. Each part position has its own codebook, which starts as that part of the ``ENTRIES`` vectors with the
smallest ids. Every round assigns each part to its nearest entry (ties to the lower index) and moves each entry to
the floor of its parts' mean; an entry without parts stays.

After the first assignment a part is known to lie in an entry's ball. The ball's radius, the largest distance in it
before the entry moved plus the move, bounds which other entries can take a part of it: those within twice the
radius, the neighbours, in order of distance. A part nearer to its entry than half of the way to the next neighbour
is in the stable core and is done; else it lies in a ring that names how many of the neighbours, the nearest ones,
are compared with it. All distances are squared integers, so the result equals that of comparing every part with
every entry.

A round is one pass over the rows; a task sends one row per part and entry (count, sums, radius), and the codebooks,
which alone come to the driver, are ``PARTS * ENTRIES`` entries. Sums are added as decimals. Each round's rows are
a written table.

Cases: vectors that are null or empty or hold null, NaN or infinite components are dropped, and so are those of
another length than the first kept one's (smallest id, null ids last, then smallest components). A length that
``PARTS`` does not divide is filled up with zeros. Scaled components beyond ±``BOUND`` stand at that bound. Fewer
than ``ENTRIES`` kept vectors make shorter codebooks. Repeated rows count as often as they come. An empty table
gives an empty result. A label's error that exceeds a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import Shared

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BOUND = 1 << 27
#: Parts that are compared at once in the first assignment.
PIECE = 1 << 14


def ceil_root(x: int) -> int:
    """The least integer whose square is ``x`` or more."""
    return isqrt(x - 1) + 1 if x > 0 else 0


@dataclass
class Balls:
    """One part's codebook: entries, and for each its neighbours in order of distance, with squared distances."""

    entries: np.ndarray
    near: list[np.ndarray]
    apart: list[np.ndarray]

    @classmethod
    def of(cls, entries: np.ndarray, radii: list[int]) -> Balls:
        """``radii``: an upper bound of the distance of any part from its entry, negative for an empty ball."""
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        near, apart = [], []
        for i, radius in enumerate(radii):
            order = np.lexsort((np.arange(len(entries)), gaps[i]))
            # Squared distances of half of the way: no entry farther than twice the radius is nearer to a part.
            order = order[(order != i) & (gaps[i][order] <= (4 * radius * radius if radius >= 0 else -1))]
            near.append(order)
            apart.append(gaps[i][order])
        return cls(entries, near, apart)


def assign_all(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point by comparing all, the lower index of equals."""
    out = np.empty(len(points), dtype=np.uint8)
    for start in range(0, len(points), PIECE):
        own = points[start : start + PIECE]
        far = np.zeros((len(own), len(entries)), dtype=np.int64)
        for d in range(points.shape[1]):
            far += (own[:, d, None] - entries[None, :, d]) ** 2
        out[start : start + PIECE] = far.argmin(axis=1)
    return out


def assign_rings(points: np.ndarray, codes: np.ndarray, balls: Balls) -> np.ndarray:
    """The nearest entry of each point, which lies in the ball of its present code."""
    out = codes.copy()
    own = ((points - balls.entries[codes]) ** 2).sum(axis=1)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(balls.entries) + 1))
    for entry, (near, apart) in enumerate(zip(balls.near, balls.apart, strict=True)):
        members = order[ends[entry] : ends[entry + 1]]
        if not len(members) or not len(near):
            continue
        # A neighbour farther than twice the part's own distance is farther from the part than its entry.
        rings = np.searchsorted(apart, 4 * own[members], "right")
        outside = rings > 0
        members, rings = members[outside], rings[outside]
        if not len(members):
            continue
        by_ring = np.argsort(-rings, kind="stable")
        members, rings = members[by_ring], rings[by_ring]
        best, code = own[members], np.full(len(members), entry)
        for k in range(int(rings[0])):
            n = int(np.searchsorted(-rings, -k, "left"))  # those whose ring is beyond k
            far = ((points[members[:n]] - balls.entries[near[k]]) ** 2).sum(axis=1)
            better = (far < best[:n]) | ((far == best[:n]) & (near[k] < code[:n]))
            best[:n] = np.where(better, far, best[:n])
            code[:n] = np.where(better, near[k], code[:n])
        out[members] = code
    return out


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and integer components of the vectors that take part."""
    vector = F.col(f"`{vector_col}`")
    x = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))))
    held = F.transform(
        vector, lambda c: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x(c) * SCALE))).cast("long")
    )
    return vectors.filter(F.coalesce(good, F.lit(False)) & (F.size(vector) > 0)).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), held.alias("parts")
    )


def _points(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Rows as (parts, rows, components of a part)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    size = -(-width // parts)
    full = np.zeros((len(flat), parts * size), dtype=np.int64)
    full[:, :width] = flat
    return np.ascontiguousarray(full.reshape(len(flat), parts, size).transpose(1, 0, 2))


def _with_codes(rows: DataFrame, width: int, parts: int, made) -> DataFrame:
    """``rows`` with new ``codes`` by ``made(points, old codes or None)``; and ``error``, to the entries given."""
    first = "codes" not in rows.columns
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, parts array<long>, codes binary, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = made()
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch.column(2), width, parts)
            old = None
            if not first:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).T
            codes, error = step(points, old)
            packed = [c.tobytes() for c in np.ascontiguousarray(codes.T)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(packed, pa.binary()), pa.array(error, pa.int64())], ["id", "label", "parts", "codes", "error"]
            )

    columns = ["id", "label", "parts"] + ([] if first else ["codes"])
    return rows.select(columns).mapInArrow(run, schema)


def _sums(rows: DataFrame, width: int, parts: int, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int], int]]:
    """Count, sums and largest squared distance from its entry of each part's and entry's points."""
    shared = Shared(rows.sparkSession, books)
    size = -(-width // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        most = len(entries[0])
        counts = np.zeros((parts, most), dtype=np.int64)
        sums = np.zeros((parts, most, size), dtype=np.int64)
        far = np.zeros((parts, most), dtype=np.int64)
        for batch in batches:
            points = _points(batch.column(0), width, parts)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts).T
            for p in range(parts):
                counts[p] += np.bincount(codes[p], minlength=most)
                np.add.at(sums[p], codes[p], points[p])
                np.maximum.at(far[p], codes[p], ((points[p] - entries[p][codes[p]]) ** 2).sum(axis=1))
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(counts[part, entry]),
                pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
                pa.array(far[part, entry]),
            ],
            ["part", "entry", "n", "sums", "far"],
        )

    told = rows.select("parts", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>, far long")
    wide = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(size)]
    found = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *wide).collect()
    return {(r.part, r.entry): (r.n, [int(r[f"s{d}"]) for d in range(size)], r.far) for r in found}


def _moved(books: list[np.ndarray], sums: dict[tuple[int, int], tuple[int, list[int], int]]) -> list[Balls]:
    """The next codebooks as balls."""
    out = []
    for p, entries in enumerate(books):
        moved, radii = entries.copy(), []
        for e in range(len(entries)):
            n, total, far = sums.get((p, e), (0, [], 0))
            if not n:
                radii.append(-1)
                continue
            moved[e] = [x // n for x in total]
            radii.append(ceil_root(far) + ceil_root(int(((moved[e] - entries[e]) ** 2).sum())))
        out.append(Balls.of(moved, radii))
    return out


def _hash(books: list[np.ndarray]) -> str:
    numbers = np.concatenate([b.reshape(-1) for b in books]) if books else np.zeros(0, np.int64)
    return hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, parts, codes of one byte a part, error) and the final codebooks, one array a part.

    ``entries`` is 256 at most.
    """
    kept = _kept(vectors, id_col, vector_col, label_col)
    first = kept.orderBy(F.asc_nulls_last("id"), "parts").limit(1).first()
    if first is None:
        empty = kept.select("*", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0), []
    width = len(first.parts)
    kept = kept.filter(F.size("parts") == width)
    start = kept.orderBy(F.asc_nulls_last("id"), "parts").limit(entries).select("parts").collect()
    table = pa.array([r.parts for r in start], pa.list_(pa.int64()))
    books = list(_points(table, width, parts))
    spark = vectors.sparkSession

    def errors(points: np.ndarray, codes: np.ndarray, used: list[np.ndarray]) -> np.ndarray:
        return sum(((points[p] - used[p][codes[p]]) ** 2).sum(axis=1) for p in range(parts))

    def by_all(used):
        def made():
            own = used.value

            def step(points, _):
                codes = np.stack([assign_all(points[p], own[p]) for p in range(parts)])
                return codes, errors(points, codes, own)

            return step

        return made

    def by_rings(used):
        def made():
            balls = used.value

            def step(points, old):
                codes = np.stack([assign_rings(points[p], old[p], balls[p]) for p in range(parts)])
                return codes, errors(points, codes, [b.entries for b in balls])

            return step

        return made

    rows = _with_codes(kept, width, parts, by_all(Shared(spark, books)))
    for _ in range(rounds):
        rows = stage_table(rows, "codes")
        balls = _moved(books, _sums(rows, width, parts, books))
        books = [b.entries for b in balls]
        rows = _with_codes(rows, width, parts, by_rings(Shared(spark, balls)))
    return rows, books


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings: int
) -> DataFrame:
    """id, code (hex), error, label_error and codebooks_sha256 of every vector that takes part."""
    rows, books = compress(vectors, id_col, vector_col, label_col, **settings)
    told = stage_table(rows.select("id", "label", F.lower(F.hex("codes")).alias("code"), "error"), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = told.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    # Few labels are broadcast by Spark's own check; of many, large ones are split by adaptive execution.
    met = told.join(by_label, _same(F.col("label"), F.col("_label")))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(_hash(books)).alias("codebooks_sha256"))
