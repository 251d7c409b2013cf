"""Conversation structure repair by lightest derivations.

A conversation's rows, in order, are edited so that the initials of its roles read ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 1, Delete 2, Insert of an empty user or assistant turn ``INSERT``; a row that is not
deleted though its text is cut short adds ``CUT_SHORT``; blank and repeated rows have to go.

Repair is a weighted deduction. An item (i, state) says that the rows from i on can be repaired from that state of
the pattern; the axioms are the ends, and a deduction joins an edit of row i, or an insertion, with the item behind
it. Its weight is (cost, rows covered, audit), the audit being the letters of the edits; every deduction adds cost
or a row and puts its letter in front, so it is monotone and never lighter than its parts. Knuth's agenda pops items
by weight; the first derivation of an item is its lightest, and work ends when the goal is popped. Two audits of the
same rows and cost are never each other's beginning, so lightest pieces make lightest wholes: a conversation of more
than ``PIECE_ROWS`` rows, or one that two tasks share, is derived piece by piece from each state to each other, and
the pieces' tables are composed in order.

Equal rows of a turn are counted before they move, the first of equal turns is found by grouping on a hash of role
and text (SHA-256), and rows are dealt by ranges of (conversation, turn, hash), so a conversation that holds a third
of all rows is spread over tasks; only its pieces' tables and its repaired text pass through one task, as a stream.

Cases: null roles and texts are one space; null turns come first and count in no gap; a null conversation id is a
conversation. Rows of one turn stand in the order of their hash. Roles are told apart by their first character, an
empty role has none. Repeated rows are duplicates. Conversations without rows have zeros and no edits. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stage_table
from .common import SPACE_CHARS, SPACE_CLASS

REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Rows that are derived at once.
PIECE_ROWS = 256
#: Derivations a task remembers.
MEMO = 1 << 16
#: States of the pattern: nothing yet, after system, user, assistant. It may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: From which states a role's initial leads to a state.
INTO: dict[int, list[tuple[str, int]]] = {
    START: [],
    SYSTEM: [("s", START)],
    USER: [("u", START), ("u", SYSTEM), ("u", ASSISTANT)],
    ASSISTANT: [("a", USER)],
}
STEP = {(before, initial): after for after, ways in INTO.items() for initial, before in ways}
LEGAL = {"su", "ua", "au"}
#: A row that has to go, in a signature. Others are their role's initial (o: any other), a capital if cut short.
GONE = "x"

TURNS = "array<struct<edit string, role string, text string>>"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def lightest(signature: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the lightest repair of rows from one state to any of others; None if there is none."""
    n = len(signature)
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", q) for q in exits]
    heapq.heapify(agenda)
    final: set[tuple[int, int]] = set()
    while agenda:
        cost, covered, audit, state = heapq.heappop(agenda)
        if (covered, state) in final:
            continue
        final.add((covered, state))
        if covered == n and state == entry:
            return cost, audit
        for initial, before in INTO[state]:
            if initial != "s":
                heapq.heappush(agenda, (cost + INSERT, covered, "I" + audit, before))
        if covered == n:
            continue
        row = signature[n - covered - 1]
        heapq.heappush(agenda, (cost + DELETE, covered + 1, "D" + audit, state))
        if row == GONE:
            continue
        held = cost + (CUT_SHORT if row.isupper() else 0)
        for initial, before in INTO[state]:
            if initial == row.lower():
                heapq.heappush(agenda, (held, covered + 1, "K" + audit, before))
            if initial != "s":
                heapq.heappush(agenda, (held + REROLE, covered + 1, "R" + audit, before))
    return None


class Repairer:
    """``lightest``, remembered: most conversations have one of few signatures."""

    def __init__(self) -> None:
        self.memo: dict[tuple[str, int, tuple[int, ...]], tuple[int, str] | None] = {}

    def __call__(self, signature: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
        key = (signature, entry, exits)
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = lightest(signature, entry, exits)
        return self.memo[key]


def edited(signature: str, rows: list[tuple[str, str]], audit: str, state: int) -> list[dict[str, str | None]]:
    """The edits in order, with role and text of what they leave; ``rows`` are those that need not go."""
    kinds, held, out = iter(signature), iter(rows), []
    for edit in audit:
        role, text = None, None
        if edit == "I":
            text = ""
        elif next(kinds) != GONE:
            role, text = next(held)
        if edit == "D":
            out.append({"edit": edit, "role": None, "text": None})
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = STEP[state, role[:1]]
        out.append({"edit": edit, "role": role, "text": text})
    return out


def damage(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The contract's damage: conv, turn, role, text and n, how often the row stands; what is dropped stands no times."""
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(id_col), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    here = kind != 0
    return conversations.select(
        F.col(f"`{id_col}`").alias("conv"),
        F.when(here, F.col("turn")).cast("long").alias("turn"),
        F.when(here, F.when(kind == 4, F.lit("user")).otherwise(told("role"))).otherwise("").alias("role"),
        F.when(here, text).otherwise("").alias("text"),
        F.when(kind == 3, 2).when(here, 1).otherwise(0).cast("long").alias("n"),
    )


def _prepared(rows: DataFrame) -> DataFrame:
    """Each distinct row of a turn, and a mark before the first of equal ones, in the order of repair."""
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    sig = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE_CHARS)), -1, 1)
    told = counted.select(
        "conv",
        "turn",
        sig.alias("sig"),
        F.lit(False).alias("mark"),
        "role",
        "text",
        "n",
        (~F.col("text").rlike(f"[^{SPACE_CLASS}]")).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut_short"),
    )
    # The turn of a null comes first.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = told.filter("n > 0 and not blank").groupBy("conv", "sig").agg(F.min(turn).alias("first"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    marks = firsts.select(
        "conv",
        F.col("first.turn").alias("turn"),
        "sig",
        F.lit(True).alias("mark"),
        none("role", "string"),
        none("text", "string"),
        none("n", "long"),
        none("blank", "boolean"),
        none("cut_short", "boolean"),
    )
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("sig").asc()]
    return told.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc())


class Piece:
    """Rows of one conversation that stand together."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.signature: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role: str, text: str, n: int, blank: bool, cut_short: bool, first: bool) -> None:
        initial = role[:1]
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        # Equal initials are never legal side by side.
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        gone = n
        if blank:
            self.blank += n
        else:
            gone -= first
            self.duplicate += gone
            if first:
                self.truncated += cut_short
                kind = initial if initial in ("s", "u", "a") else "o"
                self.signature.append(kind.upper() if cut_short else kind)
                self.rows.append((role, text))
        self.signature.append(GONE * gone)

    def __len__(self) -> int:
        return len(self.signature)


#: A piece or a whole conversation; costs and audits are by entry and exit state.
_PIECES = (
    "part int, seq int, whole boolean, signature string, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first string, last string, cost long, audit string, costs array<long>, audits array<string>, "
    f"rows array<struct<role string, text string>>, edits {TURNS}"
)


def _pieces(rows: DataFrame) -> DataFrame:
    """Whole conversations with their repair, and pieces of the others with their tables."""
    kind = rows.schema["conv"].dataType.simpleString()
    arrow = _arrow(f"conv {kind}, {_PIECES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, repair = TaskContext.get().partitionId(), Repairer()
        out: list[dict] = []
        now, seq, outer, marked = None, 0, True, None

        def told(piece: Piece, whole: bool) -> dict:
            signature = "".join(piece.signature)
            row = {k: getattr(piece, k) for k in ("conv", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")}
            row |= {"part": part, "seq": seq, "whole": whole, "signature": signature}
            if whole:
                row["cost"], row["audit"] = repair(signature, START, ENDS)
                row["edits"] = edited(signature, piece.rows, row["audit"], START)
            else:
                table = [repair(signature, p, (q,)) for p in range(4) for q in range(4)]
                row["costs"] = [t and t[0] for t in table]
                row["audits"] = [t and t[1] for t in table]
                row["rows"] = [{"role": r, "text": t} for r, t in piece.rows]
            return row

        for batch in batches:
            for conv, turn, sig, mark, role, text, n, blank, cut_short in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        # The first and the last conversation of a task may go on in another.
                        out.append(told(now, not outer))
                        seq += 1
                    outer, now = now is None, Piece(conv)
                elif len(now) >= PIECE_ROWS:
                    outer = True
                    out.append(told(now, False))
                    seq, now = seq + 1, Piece(conv)
                if mark:
                    marked = (conv, turn, sig)
                elif n:
                    now.add(turn, role, text, n, blank, cut_short, marked == (conv, turn, sig))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if now is not None:
            out.append(told(now, False))
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, f"conv {kind}, {_PIECES}")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


_ROUTES = "part int, seq int, entry int, audit string, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, whole_audit string"


def _routes(pieces: DataFrame) -> DataFrame:
    """Entry state and audit of each piece; on a conversation's last piece also its report."""
    kind = pieces.schema["conv"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated"]
    slim = pieces.select("conv", "part", "seq", *counts, "illegal", "turns", "low", "high", "first", "last", "costs", "audits")
    order = ["conv", "part", "seq"]
    arrow = _arrow(f"conv {kind}, {_ROUTES}")

    def composed(own: list[dict]) -> list[dict]:
        # For each state: cost and audit up to here, and the linked list of (piece's entry, piece's audit).
        front = {START: (0, "", None)}
        total = dict.fromkeys(counts, 0)
        illegal = turns = 0
        low = high = last = None
        for row in own:
            new: dict[int, tuple] = {}
            for p, (cost, audit, path) in front.items():
                for q in range(4):
                    if row["costs"][4 * p + q] is None:
                        continue
                    step = row["audits"][4 * p + q]
                    made = (cost + row["costs"][4 * p + q], audit + step, (path, p, step))
                    if q not in new or made[:2] < new[q][:2]:
                        new[q] = made
            front = new
            for c in counts:
                total[c] += row[c]
            illegal += row["illegal"]
            if row["first"] is not None:
                illegal += last is not None and last + row["first"] not in LEGAL
                last = row["last"]
            if row["low"] is not None:
                turns += row["turns"] - (row["low"] == high)
                low = row["low"] if low is None else low
                high = row["high"]
        cost, audit, path = min((front[q] for q in ENDS if q in front), key=lambda x: x[:2])
        out = []
        for row in reversed(own):
            path, entry, step = path
            out.append({"conv": row["conv"], "part": row["part"], "seq": row["seq"], "entry": entry, "audit": step, "final": False})
        out[0] |= total | {"final": True, "illegal": illegal, "cost": cost, "whole_audit": audit}
        out[0]["gaps"] = 0 if low is None else high - low + 1 - turns
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if own and own[0]["conv"] != row["conv"]:
                    yield pa.RecordBatch.from_pylist(composed(own), arrow)
                    own = []
                own.append(row)
        if own:
            yield pa.RecordBatch.from_pylist(composed(own), arrow)

    return slim.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, f"conv {kind}, {_ROUTES}")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations from rows (conv, turn, role, text, n: how often the row stands).

    A row per conversation or, of split ones, per piece: conv, part and seq (the order of pieces), ``edits`` (letter,
    role and text of each edit), and on the ``final`` one the report: gaps, blank, duplicate, truncated, illegal, cost
    and audit.
    """
    pieces = stage_table(_pieces(_prepared(rows)), "conversation-pieces")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    whole = pieces.filter("whole").select(
        "conv", "part", "seq", F.lit(True).alias("alone"), F.lit(True).alias("final"), "edits",
        gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    )
    split = pieces.filter("not whole")
    routes = stage_table(_routes(split), "conversation-routes")
    met = routes.join(split.select("part", "seq", "signature", "rows"), ["part", "seq"])
    kind = rows.schema["conv"].dataType.simpleString()
    kept_edits = _arrow(f"edits {TURNS}").field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                edited(r["signature"], [(x["role"], x["text"]) for x in r["rows"]], r["audit"], r["entry"])
                for r in batch.select(["signature", "rows", "audit", "entry"]).to_pylist()
            ]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("conv", "part", "seq", "final", *REPORT, "whole_audit")]
            edits = pa.array(made, kept_edits)
            names = ["conv", "part", "seq", "final", *REPORT, "audit", "edits"]
            yield pa.RecordBatch.from_arrays([*keep, edits], names)

    schema = f"conv {kind}, part int, seq int, final boolean, " + ", ".join(f"{c} long" for c in REPORT) + f", audit string, edits {TURNS}"
    parted = met.mapInArrow(run, schema).withColumn("alone", F.lit(False))
    return whole.unionByName(parted)


def _lines(edits: Column) -> Column:
    """``role:text`` of what the edits leave, joined by line feeds."""
    left = F.filter(edits, lambda e: e["edit"] != "D")
    return F.array_join(F.transform(left, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")


def report(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: the report and the digest of its repaired text."""
    columns = ["conv", *REPORT, "audit"]
    whole = repaired.filter("alone").select(*columns, F.sha2(_lines(F.col("edits")), 256).alias("repaired_sha256"))
    # Each piece's text is made where it lies; one task joins a conversation's pieces as a stream.
    left = F.exists("edits", lambda e: e["edit"] != "D")
    pieces = repaired.filter("not alone").select(
        *columns, "part", "seq", "final", F.when(left, _lines(F.col("edits")).cast("binary")).alias("lines")
    )
    kind = repaired.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, any_lines = hashlib.sha256(), False
        for batch in batches:
            places, shas = [], []
            lines, final = (batch.column(batch.schema.get_field_index(c)) for c in ("lines", "final"))
            for i in range(batch.num_rows):
                own = lines[i].as_py()
                if own is not None:
                    digest.update(b"\n" * any_lines + own)
                    any_lines = True
                if final[i].as_py():
                    places.append(i)
                    shas.append(digest.hexdigest())
                    digest, any_lines = hashlib.sha256(), False
            kept = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(len(columns))], pa.array(shas, pa.string())], [*columns, "repaired_sha256"])

    split = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(run, schema)
    return whole.unionByName(split).withColumnRenamed("conv", id_col)
