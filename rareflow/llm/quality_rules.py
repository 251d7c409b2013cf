"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per
failed rule; a policy is a mask over these bits, so verdicts under any policy, and what each rule
contributes to them, come from the ledger without reading a text again.

Cases: a null or empty text has no words, measures zero everywhere and fails ``few_words``; rows
with a null id and repeated rows are judged like any other, one row out for each row in; an empty
table gives an empty ledger; other columns are ignored. A text of one endless word is one word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, bind, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A name, its bit, and when it fails, over the measured columns."""

    name: str
    bit: int
    fails: str


#: The bit of a rule never changes; a changed rule gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
    Rule("shouting", 6, "2 * n_upper > word_chars"),
)

BASE = ("few_words", "repeated_windows")

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base-1": BASE,
    "prose-1": tuple(r.name for r in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def mask_of(policy: str, without: tuple[str, ...] = ()) -> int:
    """The bits of a policy's rules, some left out."""
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy] and r.name not in without)


def _count_of(text: Column, others: str) -> Column:
    """Code points left when all ``others``, a regular expression, are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def _windows(words: Column, n_words: Column) -> Column:
    """The hash of each window of three words, in order of place."""
    first = F.slice(words, F.lit(1), F.greatest(n_words - 2, F.lit(0)))
    return F.transform(
        first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )


def _repeated(windows: Column) -> Column:
    """The hashes that occur twice or more; most texts have none and are not sorted for it."""
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.array_distinct(
            bind(
                F.sort_array(windows),
                lambda s: F.filter(s, lambda x, i: x.eqNullSafe(F.get(s, i - 1))),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _neighbours(entries: Column) -> Column:
    """Places of sorted (key, place) entries whose key stands next to an equal one."""
    return F.transform(
        F.filter(
            entries,
            lambda e, i: e["k"].eqNullSafe(F.get(entries, i - 1)["k"])
            | e["k"].eqNullSafe(F.get(entries, i + 1)["k"]),
        ),
        lambda e: e["p"],
    )


#: So many repeated hashes are looked up one by one; more are found by sorting, with the same result.
FEW = 64


def _repeat_words(words: Column, windows: Column, repeated: Column) -> Column:
    """Words inside a window of three that occurs twice or more.

    Windows with a repeated hash are compared again as text, so two that only share a hash do not
    count. Places are sorted, so the covered words are the gaps between them, three at most each.
    """
    looked_up = F.transform(
        F.filter(
            F.transform(windows, lambda h, i: F.struct(h.alias("k"), i.alias("p"))),
            lambda e: F.array_contains(repeated, e["k"]),
        ),
        lambda e: e["p"],
    )
    by_sorting = bind(
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("k"), i.alias("p")))),
        _neighbours,
    )
    suspects = F.when(F.size(repeated) <= FEW, looked_up).otherwise(by_sorting)
    texts = F.transform(
        suspects,
        lambda p: F.struct(F.concat_ws(" ", F.slice(words, p + 1, 3)).alias("k"), p.alias("p")),
    )
    places = F.sort_array(bind(F.sort_array(texts), _neighbours))

    def covered(ps: Column) -> Column:
        gaps = F.transform(
            ps, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(ps, i + 1) - p, F.lit(3)))
        )
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    return F.when(F.size(repeated) > 0, bind(places, covered)).otherwise(F.lit(0))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col), text.alias("_text")).select(
        F.col(id_col), "_text", words_of(F.col("_text")).alias("_words")
    )
    n_words = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    windows = _windows(F.col("_words"), n_words)
    hashed = split.select("*", windows.alias("_windows"), lines.alias("_lines"))
    text = F.col("_text")
    told = hashed.select("*", _repeated(F.col("_windows")).alias("_repeated")).select(
        F.col(id_col),
        n_words.cast("long").alias("n_words"),
        (F.length(text) - _count_of(text, WORD)).cast("long").alias("word_chars"),
        _count_of(text, f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words"), F.col("_windows"), F.col("_repeated"))
        .cast("long")
        .alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count_of(text, r"[^\p{Lu}]+").cast("long").alias("n_upper"),
    )
    # Behind a generator, or the optimizer would copy the whole measurement into every later filter.
    return told.select(F.inline(F.array(F.struct(*told.columns))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every document and ``failed``, one bit per failed rule."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def verdicts(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """``base_failed`` and ``kept`` from the bits of a ledger; nothing is measured again."""
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0
    base = hit(mask_of("base-1"))
    return rows.withColumn("base_failed", base).withColumn("kept", ~(base | hit(mask_of(policy))))


def ablations(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    Documents collapse to their bit patterns first, at most two to the number of rules.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("_n"))
    mask = mask_of(policy)
    told = [r for r in RULES if r.name in POLICIES[policy]]
    entries = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in told])
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == F.col("bit")
    return (
        patterns.select("failed", "_n", F.inline(entries))
        .groupBy("rule")
        .agg(
            F.sum(F.when(hit, F.col("_n")).otherwise(F.lit(0))).alias("n_failed"),
            F.sum(F.when(alone, F.col("_n")).otherwise(F.lit(0))).alias("n_only_this"),
        )
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = "prose-1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all their columns unchanged.

    The verdict rides along with its own row, so nothing is shuffled and repeated ids cannot mix.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_judged"))
    kept = verdicts(ledger(packed, "_row", "_judged"), policy).filter("kept")
    return kept.select("_row.*")
