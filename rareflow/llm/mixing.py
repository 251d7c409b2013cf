"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, documents in the order of a hash, are packed into blocks of ``BLOCK_WORDS``. A source has as
many output slots as its target needs. Each output shard of ``SHARD_SLOTS`` slots draws its source counts from a
multinomial with the sources' shares of all slots: every slot of a shard draws a source by a number of its own. A
source's slots are handed to the shards in order, until it has no more; the slots that no shard has drawn by then
fill further shards, so the totals meet the targets exactly and all but the last shards are multinomial. Slot j of a
source stands for block perm(j) of its own pseudorandom permutation, a new one for every pass over the source; slots
and blocks are joined by that index. The last few slots are cut so that a source gives its target to the word.

Only (row, source, size, hash) is ever shuffled. The running word count of a source is a sum over hash cells
of about ``CELL_ROWS`` rows and then within the cell, so a source with a third of all rows is spread over
thousands of tasks. Slots are drawn in chunks and joined by (source, block), which no hot key can unbalance.
The small table of sources, one row each, is ranked and accumulated in one task.

Cases: a null source is a source, the last one; a null or empty text has size zero and is never taken; a
source without words has target zero. Null and repeated ids, and repeated rows, are rows like any other; rows
equal in id, size and text stand for one another. An empty table gives an empty result. Other columns are ignored
by ``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from ..session import stage_table
from .common import SPACE_CLASS, WORD

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
CELL_ROWS = 1024
#: Slots of the urn in a cell by which a draw finds its source, and ranges in which a source's shards are summed.
CELL_SLOTS = 64
CUT_SHARDS = 64
#: A source is taken at most so many times.
MOST = 3
#: The first slots after the whole ones, from which the missing words come: one part-filled block, and
#: what the short last block lacked in each pass.
EXTRA = MOST + 2
#: Multipliers of the permutations, primes just under 2**26. A block count under 2**36 is no multiple of two.
PRIMES = (67108859, 67108837)


def _number(text: Column, digits: int) -> Column:
    """A pseudorandom number of so many hexadecimal digits."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _permuted(i: Column, n: Column, seed: Column) -> Column:
    """A bijection of 0..n-1 for each seed."""
    step = F.when(n % F.lit(PRIMES[0]) != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])).cast("long")
    return (i * step + _number(seed, 12) % n) % n


def _sized(numbered: DataFrame, ident: Column, text: Column, source: Column) -> DataFrame:
    """One narrow row per row of ``numbered``, which has a column ``row``."""
    held = F.coalesce(text, F.lit(""))
    # Words are counted as the letters left when every word has become one.
    size = F.length(F.regexp_replace(F.regexp_replace(held, WORD, "x"), f"[{SPACE_CLASS}]+", ""))
    rows = numbered.select(
        ident.alias("id"), source.alias("source"), size.cast("long").alias("size"), F.xxhash64(held).alias("content"), "row"
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    place = _number(F.coalesce(F.col("id").cast("string"), F.lit("")), 15)
    return stage_table(rows.select("*", key.alias("key"), place.alias("place")), "sizes")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One narrow row per document, numbered, written once so that the numbers stay."""
    own = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    narrow = docs.select(*[c.alias(n) for c, n in zip(own, ("i", "t", "s"), strict=True)], F.monotonically_increasing_id().alias("row"))
    return _sized(narrow, F.col("i"), F.col("t"), F.col("s"))


def targets(rows: DataFrame) -> DataFrame:
    """Per source: key, number k, source_size, weight and target."""
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("k", F.row_number().over(by_name)).withColumn(
        "weight", ((F.col("k") - 1) % 3 + 1).cast("long")
    )
    cap = MOST * F.col("source_size")
    by_cap = Window.orderBy(cap / F.col("weight"), "k")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sources that reach their cap are the first ones in this order; the rest share what is left by weight.
    shares = weighed.select(
        "*",
        F.row_number().over(by_cap).alias("_at"),
        (
            (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
            / F.sum("weight").over(after)
        ).alias("_share"),
    )
    first_open = F.min(F.when(F.col("_share") * F.col("weight") <= cap, F.col("_at"))).over(all_rows)
    opened = shares.withColumn("_first", first_open)
    share = F.max(F.when(F.col("_at") == F.col("_first"), F.col("_share"))).over(all_rows)
    target = F.when(F.col("_at") < F.col("_first"), cap.cast("double")).otherwise(share * F.col("weight"))
    return opened.withColumn("target", target).select("key", "k", "source_size", "weight", "target")


def _plan(sources: DataFrame) -> DataFrame:
    """Sources with words: blocks, whole slots, and their place in the urn."""
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("long")
    planned = sources.filter("source_size > 0").select(
        "key",
        "k",
        "source_size",
        F.floor("target").cast("long").alias("wanted"),
        blocks.alias("n_blocks"),
        F.floor(F.col("target") / F.lit(BLOCK_WORDS)).cast("long").alias("n_slots"),
    )
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return planned.select(
        "*",
        F.coalesce(F.sum("n_slots").over(before), F.lit(0)).alias("urn_start"),
        F.sum("n_slots").over(everything).alias("urn"),
    )


def _drawn(plan: DataFrame, urn: int) -> DataFrame:
    """k, shard, low, high: the slots low..high (exclusive) of each source that a shard draws; all slots are in it."""
    spark = plan.sparkSession
    shares = plan.filter("n_slots > 0").select("k", "n_slots", "urn_start", (F.col("urn_start") + F.col("n_slots")).alias("urn_end"))
    # A cell of the urn holds CELL_SLOTS sources at most, so a draw meets few of them.
    first, last = F.floor(F.col("urn_start") / CELL_SLOTS), F.floor((F.col("urn_end") - 1) / CELL_SLOTS)
    cells = shares.select("k", "urn_start", "urn_end", F.explode(F.sequence(first, last)).alias("cell"))
    at = _number(F.concat_ws(":", F.lit("draw"), "id"), 14) % F.lit(urn)
    draws = spark.range(0, urn).select(F.floor(F.col("id") / SHARD_SLOTS).cast("long").alias("shard"), at.alias("at"))
    met = draws.withColumn("cell", F.floor(F.col("at") / CELL_SLOTS)).join(cells.hint("merge"), "cell")
    counts = met.filter("urn_start <= at and at < urn_end").groupBy("k", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = stage_table(counts, "draws")
    # A source's shards are summed range by range, however many they are.
    every = max(1, -(-urn // SHARD_SLOTS) // CUT_SHARDS)
    cuts = [float(every * i) for i in range(1, CUT_SHARDS)] if every > 1 else []
    summed = running_sums(counts, "shard", ["n"], ["k"], descending=False, cuts=cuts)
    met = summed.join(shares.select("k", "n_slots").hint("merge"), "k")
    low = F.col("cum_n") - F.col("n")
    given = met.select("k", "shard", low.alias("low"), F.least("cum_n", "n_slots").alias("high")).filter("low < high")
    # What no shard has drawn goes on in further shards, sources one after the other.
    drawn = given.groupBy("k").agg(F.max("high").alias("done"))
    rest = shares.select("k", "n_slots").join(drawn.hint("merge"), "k", "left").select(
        "k", F.coalesce("done", F.lit(0)).alias("low"), F.col("n_slots").alias("high")
    ).filter("low < high")
    left = rest.withColumn("before", F.coalesce(F.sum(F.col("high") - F.col("low")).over(
        Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n_shards = -(-urn // SHARD_SLOTS)
    end = F.col("before") + F.col("high") - F.col("low")
    steps = F.sequence(F.floor(F.col("before") / SHARD_SLOTS), F.floor((end - 1) / SHARD_SLOTS))
    parts = left.select("*", F.explode(steps).alias("step"))
    begin = F.greatest(F.col("before"), F.col("step") * SHARD_SLOTS) - F.col("before") + F.col("low")
    stop = F.least(end, (F.col("step") + 1) * SHARD_SLOTS) - F.col("before") + F.col("low")
    further = parts.select("k", (F.col("step") + n_shards).alias("shard"), begin.alias("low"), stop.alias("high"))
    return given.unionByName(further)


def slots(sources: DataFrame) -> DataFrame:
    """Every output slot: key, k, j, block, copy (which pass over the source), take (words), shard.

    The slots that only fill up a source's target come after its whole ones and go to the last shard.
    """
    plan = stage_table(_plan(sources), "plan")
    urn = plan.agg(F.max("urn")).first()[0] or 0
    ranges = _drawn(plan, urn).withColumn("j", F.explode(F.sequence(F.col("low"), F.col("high") - 1))).select("k", "shard", "j")
    whole = ranges.join(plan.hint("merge"), "k")
    more = F.least(F.col("n_slots") + EXTRA, MOST * F.col("n_blocks"))
    extra = plan.filter(more > F.col("n_slots")).select(
        "*", F.explode(F.sequence(F.col("n_slots"), more - 1)).alias("j")
    )

    def with_block(rows: DataFrame) -> DataFrame:
        n, j = F.col("n_blocks"), F.col("j")
        turn = F.floor(j / n).cast("long")
        block = _permuted(j % n, n, F.concat_ws(":", "k", turn))
        return rows.withColumn("copy", turn + 1).withColumn("block", block).withColumn(
            "take", F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("source_size") - F.col("block") * BLOCK_WORDS)
        )

    whole = with_block(whole)
    given = whole.groupBy("key").agg(F.sum("take").alias("given"))
    before = Window.partitionBy("key").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("wanted") - F.coalesce("given", F.lit(0)) - F.coalesce(F.sum("take").over(before), F.lit(0))
    fill = (
        with_block(extra)
        .join(given.hint("merge"), "key", "left")
        .withColumn("take", F.greatest(F.lit(0).cast("long"), F.least("take", missing)))
        .filter("take > 0")
        .withColumn("shard", F.lit(max(0, urn - 1) // SHARD_SLOTS).cast("long"))
    )
    columns = ["key", "k", "j", "block", "copy", "take", "shard"]
    return whole.select(columns).unionByName(fill.select(columns))


def shard_counts(sources: DataFrame) -> DataFrame:
    """How many slots of each source an output shard draws."""
    return slots(sources).groupBy("shard", "k").agg(F.count(F.lit(1)).alias("n_slots"))


def pieces(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """What the mix takes: row, copy, shard, slot j of the source and the words begin..end (exclusive) of the document."""
    full = rows.filter("size > 0")
    cells = max(1, -(-full.count() // CELL_ROWS))
    cell = F.shiftright(F.shiftright("place", 30) * F.lit(cells), 30)
    own = full.withColumn("cell", cell)
    sums = own.groupBy("key", "cell").agg(F.sum("size").alias("words"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cell_start = sums.select(
        "key",
        "cell",
        F.coalesce(F.sum("words").over(before(Window.partitionBy("key").orderBy("cell"))), F.lit(0)).alias("start"),
    )
    inside = Window.partitionBy("key", "cell").orderBy("place", "id", "size", "content", "row")
    placed = (
        own.withColumn("_in", F.coalesce(F.sum("size").over(before(inside)), F.lit(0)))
        .join(cell_start.hint("merge"), ["key", "cell"])
        .select("key", "row", "size", (F.col("start") + F.col("_in")).alias("start"))
    )
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    blocks = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    at = F.col("block") * BLOCK_WORDS
    # Both sides grow with the corpus.
    met = blocks.join(slots(sources).select("key", "block", "j", "copy", "take", "shard").hint("merge"), ["key", "block"])
    cut = met.select(
        "row",
        "copy",
        "shard",
        "j",
        (F.greatest("start", at) - F.col("start")).alias("begin"),
        (F.least(F.col("start") + F.col("size"), at + F.col("take")) - F.col("start")).alias("end"),
    )
    return cut.filter("end > begin")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target and taken (words, repeats counted), one row per document."""
    rows = sized(docs, id_col, text_col, source_col)
    sources = stage_table(targets(rows), "targets")
    taken = pieces(rows, sources).groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    told = rows.join(sources.select("key", "source_size", "target"), "key").join(taken, "row", "left")
    return told.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, all columns kept: one row for each copy of a document that is taken.

    A copy that is taken whole keeps its text unchanged; of others the taken words stay, with the white space
    between them.
    """
    # The row travels as one value, so that no name of its columns can clash.
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = stage_table(docs.select(packed.alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    doc = F.col("doc")
    rows = _sized(numbered, doc.getField(id_col), doc.getField(text_col), doc.getField(source_col))
    sources = stage_table(targets(rows), "targets")
    cuts = (
        pieces(rows, sources)
        .groupBy("row", "copy")
        .agg(
            F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_cuts"),
            F.sum(F.col("end") - F.col("begin")).alias("_taken"),
        )
    )
    narrow = cuts.join(rows.select("row", F.col("size").alias("_size")).hint("merge"), "row")
    met = numbered.join(narrow.hint("merge"), "row")
    text = doc.getField(text_col)
    tokens = F.regexp_extract_all(text, F.lit(f"{WORD}[{SPACE_CLASS}]*"), F.lit(0))
    met = met.withColumn("_tokens", F.when(F.col("_taken") < F.col("_size"), tokens))
    part = F.array_join(
        F.transform(
            "_cuts",
            lambda c: F.array_join(
                F.slice(F.col("_tokens"), (c["begin"] + 1).cast("int"), (c["end"] - c["begin"]).cast("int")), ""
            ),
        ),
        "",
    )
    cut_text = F.regexp_replace(part, f"[{SPACE_CLASS}]+$", "")
    taken = F.when(F.col("_taken") == F.col("_size"), text).otherwise(cut_text)
    return met.select(*[(taken if c == text_col else doc.getField(c)).alias(c) for c in docs.columns])


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix shard by shard: shard, source, slot, id and the words begin..end (exclusive) that the slot takes of it."""
    rows = sized(docs, id_col, text_col, source_col)
    sources = stage_table(targets(rows), "targets")
    told = pieces(rows, sources).join(rows.select("row", "id", "source").hint("merge"), "row")
    return told.select("shard", "source", F.col("j").alias("slot"), "copy", F.col("id").alias(id_col), "begin", "end")
