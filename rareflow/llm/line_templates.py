"""Recurring lines across documents, by a fixed-depth tree of line templates.

A line goes to the node of its word count and its first ``DEPTH`` words; words that carry digits, addresses and the
like stand as ``<*>``. A node's pattern has, at each place, the word that more than half of its distinct lines have
there, or ``<*>``; lines that agree with it in ``SIMILAR`` of their words belong to the node's template. The others
go one level down, to the node of their word at the place where the node's lines have the fewest words, and so on
for ``LEVELS`` levels; what is left over is its own template. A template that stands in two documents or more is
dropped everywhere but in the first of them (smallest id), so no text is lost altogether. One rule holds for lines
of any length and tables of any size.

A majority is found by pairing off words that differ, task by task and then node by node, and confirmed by counting;
how many words a place has is told by a bitmap of 64 marks. Both are small arrays that add up in any order, so a node
that a third of all lines fall into is never gathered, and the tree costs the same few passes whatever the lines.
Only lines that share a node with another line send their words, each once. Lines are compared as hashes of 128 bits,
words within a node as hashes of 64. Text moves once, when the dropped lines are taken out; the few templates
that hold over 1/``HOT_SHARE`` of all lines are broadcast.

Cases: null and empty texts have no template and stay as they are, null ids come last in the order, rows equal in id
and text are one document and are treated alike. A line whose words are all variable stands for its own words. Lines
without a word are never dropped. An empty table gives an empty result. Other columns stay, whatever their names.
Words are told apart by ASCII white space, lines by the line feed alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import joined

DEPTH = 3
SIMILAR = 0.8
LEVELS = 3
HOT_SHARE = 1000
ANY = b"<*>"
#: What makes a word variable: digits, addresses, paths.
VARIABLE = re.compile(rb"[0-9@]|://")
#: Nodes whose sums a task holds at once.
HELD_NODES = 1 << 14
NAME = ["line", "more"]


def masked(line: bytes) -> list[bytes]:
    words = line.split()
    if VARIABLE.search(line):
        words = [ANY if VARIABLE.search(w) else w for w in words]
        if all(w == ANY for w in words):
            words = line.split()
    return words


def signed(n: int) -> int:
    return n - (1 << 63)


def places(text: bytes | None) -> Iterator[tuple[int, tuple[int, int], list[int], list[bytes]]]:
    """Node, line (two halves of its hash), line numbers and masked words of each distinct line."""
    found: dict[tuple[int, int], tuple[int, list[int], list[bytes]]] = {}
    for number, line in enumerate((text or b"").split(b"\n")):
        words = masked(line)
        if not words:
            continue
        whole = xxhash.xxh128_intdigest(b" ".join(words))
        name = signed(whole >> 64), signed(whole & ((1 << 64) - 1))
        if name in found:
            found[name][1].append(number)
        else:
            node = xxhash.xxh64_intdigest(b" ".join([b"%d" % len(words), *words[:DEPTH]]))
            found[name] = (signed(node), [number], words)
    for name, (node, numbers, words) in found.items():
        yield node, name, numbers, words


def _order(id_col: str, text_col: str) -> Column:
    ident = F.col(f"`{id_col}`")
    return F.struct(
        ident.isNull().alias("none"), ident.alias("id"), F.xxhash64(ident, F.col(f"`{text_col}`")).alias("hash")
    )


def _occurrences(slim: DataFrame) -> DataFrame:
    """doc, node, line, more, at: one row per document and distinct line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                for node, name, at, _ in places(text.as_py()):
                    rows.append(i)
                    found.append((node, *name, at))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["doc", "node", "line", "more", "at"]
            )

    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc {kind}, node long, line long, more long, at array<int>")


def _shared_lines(occurrences: DataFrame, slim: DataFrame) -> DataFrame:
    """node, line, more and words (hashes) of every distinct line that is not alone in its node."""
    nodes = occurrences.groupBy("node").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    several = nodes.filter("low < high").select("node")
    # The first document of a line sends its words.
    firsts = joined(occurrences, several, ["node"]).groupBy(*NAME).agg(F.min("doc").alias("doc"))
    wanted = firsts.groupBy("doc").agg(F.collect_set("line").alias("wanted"))
    texts = joined(slim, wanted, ["doc"]).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lines in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                chosen = set(lines)
                for node, name, _, words in places(text.as_py()):
                    if name[0] in chosen:
                        rows.append((node, *name, [signed(xxhash.xxh64_intdigest(w)) for w in words]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "line", "more", "words"])

    found = texts.mapInArrow(run, "node long, line long, more long, words array<long>")
    # Documents equal in id and text have sent the same lines.
    return found.dropDuplicates(NAME)


State = tuple[np.ndarray, ...]


def _summed(
    rows: DataFrame, names: list[str], start: Callable[..., State], add: Callable[[State, State], State]
) -> DataFrame:
    """Per node, the sum of its rows' states (arrays named ``names``), first within each task."""
    schema = "node long, " + ", ".join(f"{n} array<long>" for n in names)

    def batch_of(held: dict[int, State]) -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.int64())]
        columns += [pa.array([s[i] for s in held.values()], pa.list_(pa.int64())) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, ["node", *names])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, State] = {}
        for batch in batches:
            lists = [[np.asarray(x, dtype=np.int64) for x in c.to_pylist()] for c in batch.columns[1:]]
            for node, *values in zip(batch.column(0).to_pylist(), *lists, strict=True):
                own = start(*values)
                held[node] = add(held[node], own) if node in held else own
            if len(held) > HELD_NODES:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        state: State = ()
        done: dict[int, State] = {}
        for batch in batches:
            lists = [[np.asarray(x, dtype=np.int64) for x in c.to_pylist()] for c in batch.columns[1:]]
            for node, *own in zip(batch.column(0).to_pylist(), *lists, strict=True):
                if node == now:
                    state = add(state, tuple(own))
                    continue
                if now is not None:
                    done[now] = state
                now, state = node, tuple(own)
            if len(done) > HELD_NODES:
                yield batch_of(done)
                done = {}
        if now is not None:
            done[now] = state
        if done:
            yield batch_of(done)

    parts = rows.mapInArrow(within, schema)
    return parts.repartition("node").sortWithinPartitions("node").mapInArrow(across, schema)


def _vote(words: np.ndarray) -> State:
    return np.ones(1, np.int64), words, np.ones(len(words), np.int64)


def _paired_off(a: State, b: State) -> State:
    """The candidate of each place and its lead; a word that more than half have is always the candidate."""
    same = a[1] == b[1]
    ahead = a[2] >= b[2]
    lead = np.where(same, a[2] + b[2], np.abs(a[2] - b[2]))
    return a[0] + b[0], np.where(same | ahead, a[1], b[1]), lead


def _marks(words: np.ndarray, candidate: np.ndarray) -> State:
    bits = (np.uint64(1) << (words.view(np.uint64) & np.uint64(63))).view(np.int64)
    return (words == candidate).astype(np.int64), bits


def _marked(a: State, b: State) -> State:
    return a[0] + b[0], a[1] | b[1]


def _patterns(rest: DataFrame) -> DataFrame:
    """Per node of several lines: pattern (null where it is free) and the place that splits it (null if none does)."""
    votes = _summed(rest.select("node", "words"), ["n", "candidate", "lead"], _vote, _paired_off)
    votes = stage_table(votes.select("node", F.col("n")[0].alias("n"), "candidate").filter("n > 1"), "votes")
    told = joined(rest, votes, ["node"]).select("node", "words", "candidate")
    marks = _summed(told, ["hits", "marks"], _marks, _marked)
    each = F.arrays_zip("candidate", "hits", "marks")
    met = marks.join(votes, "node")
    pattern = F.transform(each, lambda x: F.when(2 * x["hits"] > F.col("n"), x["candidate"]))
    # Of the places where the lines differ the one with the fewest marks, the first of equals.
    choice = F.transform(each, lambda x, i: F.when(x["hits"] < F.col("n"), F.struct(F.bit_count(x["marks"]).alias("n_marks"), i.alias("place"))))
    return met.select("node", pattern.alias("pattern"), F.array_min(choice)["place"].alias("split"))


def templates(occurrences: DataFrame, slim: DataFrame) -> DataFrame:
    """line, more, template, again (two halves of its name): for lines that agree with a pattern of their node."""
    rest = stage_table(_shared_lines(occurrences, slim), "node-lines")
    found: list[DataFrame] = []
    for level in range(LEVELS):
        patterns = _patterns(rest)
        agree = F.size(F.filter(F.zip_with("words", "pattern", lambda a, b: a.eqNullSafe(b)), lambda x: x))
        alike = (agree >= SIMILAR * F.size("words")) & (F.size("words") == F.size("pattern"))
        told = joined(rest, patterns, ["node"]).select("node", *NAME, "words", "split", alike.alias("joins"))
        told = stage_table(told, "node-rounds")
        name = [F.xxhash64(F.lit(salt), "node").alias(n) for n, salt in (("template", "node"), ("again", "again"))]
        found.append(told.filter("joins").select(*NAME, *name))
        down = F.xxhash64("node", F.lit(level), "split", F.get("words", F.col("split")))
        rest = told.filter("not joins and split is not null").select(down.alias("node"), *NAME, "words")
    return reduce(DataFrame.unionByName, found)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (order key), drop (line numbers): what goes, for documents that lose something."""
    text = F.col(f"`{text_col}`")
    slim = docs.select(_order(id_col, text_col).alias("doc"), text.cast("binary").alias("text"))
    occurrences = stage_table(_occurrences(slim), "line-places")
    merged = stage_table(templates(occurrences, slim), "templates")
    named = joined(occurrences.drop("node"), merged, NAME, "left").select(
        "doc", "at", F.coalesce("template", "line").alias("template"), F.coalesce("again", "more").alias("again")
    )
    key = ["template", "again"]
    spread = named.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    recurring = stage_table(spread.filter("first <> last").drop("last"), "recurring")
    total = recurring.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_SHARE templates are so frequent.
    often = F.col("n") > F.lit(total / HOT_SHARE)
    hot = F.broadcast(recurring.filter(often))
    met = named.join(hot, key).unionByName(
        named.join(hot.select(key), key, "left_anti").join(recurring.filter(~often), key)
    )
    gone = met.filter("doc <> first")
    return gone.groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("drop"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", details: bool = True) -> DataFrame:
    """The rows of ``docs`` without recurring lines; with ``details`` also n_lines and n_dropped."""
    gone = dropped_lines(docs, id_col, text_col)
    # The row travels as one value, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _order(id_col, text_col).alias("doc"))
    text = F.col("row").getField(text_col)
    met = rows.join(gone, "doc", "left").withColumn("lines", F.split(text, "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    left = F.when(F.col("drop").isNull(), text).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    columns = [(left if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    if details:
        columns += [
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size(F.array_distinct("drop")), F.lit(0)).cast("long").alias("n_dropped"),
        ]
    return met.select(columns)
