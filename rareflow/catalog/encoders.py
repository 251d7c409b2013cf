"""Queries: encoders, robust transforms, learned-value joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoders, woe
from ..operators.lookup import attach
from ..operators.ordered import cut_index
from ..operators.splits import assign_folds, holdout_split, part
from ..schema import LABEL, ROW_ID
from ..sources.star import read_table
from .base import (
    FEATURES,
    HOLDOUT_SQL,
    counts,
    query,
    r6,
    rounded,
    staged_counts,
    with_sql,
)

TRAIN = "(SELECT * FROM parts WHERE split = 'train')"


def _all_and_train(spark, sf_dir):
    df = staged_counts(spark, sf_dir).select(ROW_ID, *FEATURES, LABEL)
    return df, part(holdout_split(df), "train")


# ------------------------------------------------------------------ quantile bins


def _edges(c: str) -> str:
    points = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {i / 8}e0)" for i in range(9))
    return f"list_sort(list_distinct([{points}])) AS e_{c}"


_BIN_SQL = ", ".join(
    f"CAST(len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda q: q <= {c})) AS INTEGER) AS {c}_bin"
    for c in FEATURES
)


@query(
    "e01_quantile_bins",
    with_sql(
        f"SELECT row_id, label_1, {_BIN_SQL} FROM counts, edges",
        HOLDOUT_SQL + f", edges AS (SELECT {', '.join(map(_edges, FEATURES))} FROM {TRAIN})",
    ),
)
def quantile_bins(spark, sf_dir):
    df, train = _all_and_train(spark, sf_dir)
    return encoders.QuantileBinner().fit(train, FEATURES).transform(df)


# ------------------------------------------------------------------ weight of evidence

_PREBIN_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(len(list_filter(e_{c}, lambda q: q <= {c})) AS INTEGER) AS bin,"
    f" label_1 FROM {TRAIN}, edges"
    for c in FEATURES
)
_PREBIN_SQL = (
    HOLDOUT_SQL
    + f", edges_0 AS (SELECT {', '.join(f'min({c}) AS lo_{c}, [' + ', '.join(f'quantile_cont(CAST({c} AS DOUBLE), {i / 20}e0)' for i in range(20)) + f'] AS q_{c}' for c in FEATURES)} FROM {TRAIN}),"
    + f" edges AS (SELECT {', '.join(f'list_filter(list_distinct(q_{c}), lambda q: q > lo_{c}) AS e_{c}' for c in FEATURES)} FROM edges_0),"
    + f" prebins AS (SELECT feature, bin, count(*) AS n, CAST(sum(label_1) AS BIGINT) AS events FROM ({_PREBIN_CELLS}) GROUP BY 1, 2)"
)


@query("e02_prebin_counts", with_sql("SELECT * FROM prebins", _PREBIN_SQL))
def prebin_staged_counts(spark, sf_dir):
    _, train = _all_and_train(spark, sf_dir)
    return woe.bin_counts(train, woe.prebin_cuts(train, FEATURES))


def woe_table_sql(source: str) -> str:
    """Binning table over a (feature, bin, n, events) source, total rows with a null bin."""
    return f""",
tot AS (SELECT feature AS tf, sum(n) AS an, sum(events) AS ae FROM {source} GROUP BY 1),
cells AS (SELECT *, CAST(n - events AS DOUBLE) / (an - ae) AS gs, CAST(events AS DOUBLE) / ae AS bs
          FROM {source} JOIN tot ON tf = feature),
wcells AS (SELECT *, CASE WHEN n > events AND events > 0 THEN ln(gs / bs) ELSE 0e0 END AS w FROM cells),
table_rows AS (
  SELECT feature, bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS DOUBLE) / max(an) AS share,
         CAST(sum(n - events) AS BIGINT) AS non_events, CAST(sum(events) AS BIGINT) AS events,
         CAST(sum(events) AS DOUBLE) / sum(n) AS event_rate,
         CASE WHEN grouping(bin) = 0 THEN max(w) END AS woe, sum((gs - bs) * w) AS iv,
         grouping(bin) AS is_total
  FROM wcells GROUP BY GROUPING SETS ((feature, bin), (feature)))"""


_TABLE_SELECT = (
    f"SELECT feature, bin, n, {r6('share', 'share')}, non_events, events,"
    f" {r6('event_rate', 'event_rate')}, {r6('woe', 'woe')}, {r6('iv', 'iv')},"
    " CAST(is_total AS TINYINT) AS is_total FROM table_rows"
)


@query("e02_prebin_information", with_sql(_TABLE_SELECT, _PREBIN_SQL + woe_table_sql("prebins")))
def prebin_information(spark, sf_dir):
    _, train = _all_and_train(spark, sf_dir)
    return rounded(woe.woe_table(woe.bin_counts(train, woe.prebin_cuts(train, FEATURES))))


@query("e02_merged_bins")
def merged_bins(spark, sf_dir):
    _, train = _all_and_train(spark, sf_dir)
    return rounded(woe.OptimalBinningWOE().fit(train, FEATURES).binning_tables(train))


# Fixed cuts, so that the application of WOE can be checked by SQL.
FIXED_CUTS = {"num_links": [1.0, 2.0, 3.0], "num_urgent_keywords": [1.0, 2.0], "num_words": [60.0, 120.0]}
_FIXED_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {' + '.join(f'CAST({c} >= {k}e0 AS INTEGER)' for k in cuts)} AS bin,"
    f" label_1 FROM {TRAIN}"
    for c, cuts in FIXED_CUTS.items()
)
_FIXED_SQL = (
    HOLDOUT_SQL
    + f", fixed AS (SELECT feature, bin, count(*) AS n, CAST(sum(label_1) AS BIGINT) AS events FROM ({_FIXED_CELLS}) GROUP BY 1, 2)"
    + woe_table_sql("fixed")
)


def _fixed_woe(train):
    """WOE of fixed cuts from the train counts (at most four rows per feature)."""
    rows = woe.woe_table(woe.bin_counts(train, FIXED_CUTS)).filter("is_total = 0").collect()
    values = {
        c: [r["woe"] for r in sorted((r for r in rows if r["feature"] == c), key=lambda r: r["bin"])]
        for c in FIXED_CUTS
    }
    return woe.FittedWOE(FIXED_CUTS, values)


_FIXED_APPLY = ", ".join(
    r6(
        f"(SELECT woe FROM table_rows WHERE feature = '{c}' AND is_total = 0 AND bin = "
        + " + ".join(f"CAST(counts.{c} >= {k}e0 AS INTEGER)" for k in cuts)
        + ")",
        f"{c}_woe",
    )
    for c, cuts in FIXED_CUTS.items()
)


@query("e03_woe_fixed_cuts", with_sql(f"SELECT row_id, label_1, {_FIXED_APPLY} FROM counts", _FIXED_SQL))
def woe_fixed(spark, sf_dir):
    df, train = _all_and_train(spark, sf_dir)
    return rounded(_fixed_woe(train).transform(df.select(ROW_ID, LABEL, *FIXED_CUTS)))


@query("e04_binning_tables", with_sql(_TABLE_SELECT, _FIXED_SQL))
def binning_tables(spark, sf_dir):
    _, train = _all_and_train(spark, sf_dir)
    return rounded(woe.woe_table(woe.bin_counts(train, FIXED_CUTS)))


# ------------------------------------------------------------------ target encoding

TE = ["num_words", "num_links", "num_urgent_keywords"]
_PRIOR = f", prior AS (SELECT avg(label_1) AS p FROM {TRAIN})"
_MAPS = "".join(
    f", map_{c} AS (SELECT {c} AS value, count(*) AS n, (sum(label_1) + p * 20e0) / (count(*) + 20e0) AS te"
    f" FROM {TRAIN}, prior GROUP BY {c}, p)"
    for c in TE
)


@query(
    "e05_smoothed_target_map",
    with_sql(f"SELECT value, n, {r6('te', 'te')} FROM map_num_words", HOLDOUT_SQL + _PRIOR + _MAPS),
)
def smoothed_map(spark, sf_dir):
    _, train = _all_and_train(spark, sf_dir)
    return rounded(encoders.target_map(train, "num_words")[0])


_FOLDS = (
    ", ftrain AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY label_1 ORDER BY h, row_id) - 1 AS INTEGER)"
    " AS fold FROM parts WHERE split = 'train')"
)
_OOF_JOINS = "".join(
    f", s_{c} AS (SELECT {c} AS v, fold, count(*) AS n, sum(label_1) AS e FROM ftrain GROUP BY 1, 2),"
    f" o_{c} AS (SELECT v, fold, sum(n) OVER (PARTITION BY v) - n AS n_o,"
    f" sum(e) OVER (PARTITION BY v) - e AS e_o FROM s_{c})"
    for c in TE
)
_OOF_VALUES = ", ".join(
    r6(
        f"CASE WHEN o_{c}.n_o > 0 THEN (o_{c}.e_o + p * 20e0) / (o_{c}.n_o + 20e0) ELSE p END",
        f"{c}_te",
    )
    for c in TE
)
_OOF_FROM = " ".join(
    f"JOIN o_{c} ON o_{c}.v = ftrain.{c} AND o_{c}.fold = ftrain.fold" for c in TE
)


@query(
    "e06_out_of_fold_target",
    with_sql(
        f"SELECT ftrain.row_id, ftrain.label_1, ftrain.fold, {_OOF_VALUES}"
        f" FROM ftrain {_OOF_FROM} CROSS JOIN prior",
        HOLDOUT_SQL + _PRIOR + _FOLDS + _OOF_JOINS,
    ),
)
def out_of_fold(spark, sf_dir):
    _, train = _all_and_train(spark, sf_dir)
    folded = assign_folds(train).select(ROW_ID, LABEL, "fold", *TE)
    return rounded(encoders.CrossFitTargetEncoder().fit(folded, TE).transform_train(folded))


@query(
    "e07_target_apply",
    with_sql(
        f"SELECT row_id, label_1, {', '.join(r6(f'coalesce(map_{c}.te, p)', f'{c}_te') for c in TE)}"
        f" FROM parts {' '.join(f'LEFT JOIN map_{c} ON map_{c}.value = {c}' for c in TE)}"
        " CROSS JOIN prior WHERE split <> 'train'",
        HOLDOUT_SQL + _PRIOR + _MAPS,
    ),
)
def target_apply(spark, sf_dir):
    df = staged_counts(spark, sf_dir).select(ROW_ID, LABEL, *TE)
    parts = holdout_split(df)
    fitted = encoders.CrossFitTargetEncoder().fit(part(parts, "train"), TE)
    held_out = parts.filter(F.col("split") != "train").drop("split")
    return rounded(fitted.transform(held_out))


_WIDE = "9007199254740992 + l_orderkey % 7"


@query(
    "e07_typed_target_map",
    f"""WITH r AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_linestatus AS mode, {_WIDE} AS wide FROM lineitem),
        p AS (SELECT avg(y) AS p FROM r),
        c AS (SELECT 'mode' AS feature, mode AS value, y FROM r
              UNION ALL SELECT 'wide', CAST(wide AS VARCHAR), y FROM r)
        SELECT feature, value, count(*) AS n, {r6('(sum(y) + p * 20e0) / (count(*) + 20e0)', 'te')}
        FROM c CROSS JOIN p GROUP BY feature, value, p""",
)
def typed_target_map(spark, sf_dir):
    """A string column and integers that a double cannot tell apart."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias(LABEL),
        F.col("l_linestatus").alias("mode"),
        (F.lit(2**53) + F.col("l_orderkey") % 7).alias("wide"),
    )
    return rounded(encoders.CrossFitTargetEncoder().fit(rows, ["mode", "wide"]).full_map())


@query(
    "j01_map_with_default",
    with_sql(
        f"SELECT row_id, {r6('coalesce(te, p)', 'te')} FROM counts LEFT JOIN map_num_words"
        " ON value = num_words CROSS JOIN prior",
        HOLDOUT_SQL + _PRIOR + _MAPS,
    ),
)
def map_with_default(spark, sf_dir):
    df, train = _all_and_train(spark, sf_dir)
    table, prior = encoders.target_map(train, "num_words")
    mapped = attach(
        df.select(ROW_ID, "num_words"),
        table.withColumnRenamed("value", "num_words"),
        ["num_words"],
        ["te"],
        rows_column="n",
    )
    return rounded(mapped.select(ROW_ID, F.coalesce("te", F.lit(prior)).alias("te")))


@query(
    "j05_bin_audit",
    with_sql(
        "SELECT bin, count(*) AS n, min(num_words) AS low, max(num_words) AS high FROM ("
        "SELECT num_words, CAST(num_words >= 60 AS INTEGER) + CAST(num_words >= 120 AS INTEGER) AS bin"
        " FROM counts) GROUP BY 1"
    ),
)
def bin_audit(spark, sf_dir):
    cuts = FIXED_CUTS["num_words"]
    df = counts(spark, sf_dir).select("num_words", cut_index("num_words", cuts).alias("bin"))
    return df.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("num_words").alias("low"), F.max("num_words").alias("high")
    )


# ------------------------------------------------------------------ smoothing


@query(
    "e08_smoothable_columns",
    with_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature FROM counts HAVING max(CASE WHEN {c} NOT IN (0, 1) THEN 1 ELSE 0 END) = 1"
            for c in [*FEATURES, "label_1"]
        )
    ),
)
def smoothable(spark, sf_dir):
    df = staged_counts(spark, sf_dir).select(*FEATURES, LABEL, (F.col("num_links") > 0).cast("int").alias("has_links"))
    chosen = encoders.smoothable_columns(df)
    # The chosen names, attached to the table's column list.
    names = F.array(*[F.lit(c) for c in df.columns])
    kept = F.filter(names, lambda c: c.isin(chosen))
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(kept).alias("feature"))


_BOUNDS = ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.01e0) AS lo_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.99e0) AS hi_{c}"
    for c in FEATURES
)
_CLIPPED = ", ".join(f"least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}) AS {c}" for c in FEATURES)


@query(
    "e09_winsorise",
    with_sql(
        f"SELECT row_id, label_1, {', '.join(r6(c, c) for c in FEATURES)}"
        f" FROM (SELECT row_id, label_1, {_CLIPPED} FROM counts, bounds)",
        HOLDOUT_SQL + f", bounds AS (SELECT {_BOUNDS} FROM {TRAIN})",
    ),
)
def winsorise(spark, sf_dir):
    df, train = _all_and_train(spark, sf_dir)
    return rounded(encoders.FeatureSmoothing("winsor").fit(train, FEATURES).transform(df))


_UNIFORM = ["num_words", "num_links"]
_NQ = 1000


def _uniform(c: str) -> str:
    """Interpolated rank against the reference quantiles; plateaus take their middle."""
    q = f"(SELECT v, CAST(i AS DOUBLE) / {_NQ - 1} AS u FROM refs WHERE feature = '{c}')"
    x = f"w.{c}"
    return (
        f"""round(CASE WHEN {x} <= (SELECT min(v) FROM {q}) THEN 0e0
              WHEN {x} >= (SELECT max(v) FROM {q}) THEN 1e0
              WHEN (SELECT count(*) FROM {q} WHERE v = {x}) > 0
                THEN (SELECT (min(u) + max(u)) / 2e0 FROM {q} WHERE v = {x})
              ELSE (SELECT a.u + (b.u - a.u) * ({x} - a.v) / (b.v - a.v)
                    FROM (SELECT max(v) AS v, max(u) AS u FROM {q} WHERE v < {x}) a,
                         (SELECT min(v) AS v, min(u) AS u FROM {q} WHERE v > {x}) b) END, 6) + 0.0"""
    )


_LEVELS = ", ".join(f"{i}e0 / {_NQ - 1}e0" for i in range(_NQ))
_REFS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, unnest(range(0, {_NQ})) AS i, unnest(quantile_cont({c}, [{_LEVELS}])) AS v FROM wtrain"
    for c in _UNIFORM
)
_WTRAIN = ", ".join(f"least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}) AS {c}" for c in _UNIFORM)


@query(
    "e10_winsor_quantile",
    with_sql(
        f"""SELECT counts.row_id, label_1, {', '.join(f'm_{c}.u AS {c}' for c in _UNIFORM)} FROM counts
            CROSS JOIN bounds
            {' '.join(f'JOIN m_{c} ON m_{c}.{c} = least(greatest(CAST(counts.{c} AS DOUBLE), lo_{c}), hi_{c})' for c in _UNIFORM)}""",
        HOLDOUT_SQL
        + f", bounds AS (SELECT {_BOUNDS} FROM {TRAIN})"
        + f", wtrain AS (SELECT {_WTRAIN} FROM {TRAIN}, bounds)"
        + f", wall AS (SELECT {_WTRAIN} FROM counts, bounds)"
        + f", refs AS ({_REFS})"
        + "".join(
            f", m_{c} AS (SELECT w.{c}, {_uniform(c)} AS u FROM (SELECT DISTINCT {c} FROM wall) w)"
            for c in _UNIFORM
        ),
    ),
)
def winsor_quantile(spark, sf_dir):
    df, train = _all_and_train(spark, sf_dir)
    fitted = encoders.FeatureSmoothing().fit(train, _UNIFORM)
    return rounded(fitted.transform(df.select(ROW_ID, LABEL, *_UNIFORM)))


# ------------------------------------------------------------------ standardising, periodic


@query(
    "e15_standardise",
    with_sql(
        f"SELECT row_id, label_1, {', '.join(r6(f'({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1e0 END', c) for c in FEATURES)}"
        " FROM counts, moments",
        HOLDOUT_SQL
        + f", moments AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM {TRAIN})",
    ),
)
def standardise(spark, sf_dir):
    df, train = _all_and_train(spark, sf_dir)
    return rounded(encoders.Standardizer().fit(train, FEATURES).transform(df))


_FREQ_COLUMNS = ["num_links", "num_urgent_keywords", "num_spelling_errors"]
_FREQUENCIES = encoders.periodic_frequencies(len(_FREQ_COLUMNS))


def _periodic_sql():
    import math

    out = []
    for c, row in zip(_FREQ_COLUMNS, _FREQUENCIES):
        for i, f in enumerate(row):
            angle = f"CAST('{2.0 * math.pi * f!r}' AS DOUBLE) * {c}"
            out += [r6(f"sin({angle})", f"{c}_sin_{i}"), r6(f"cos({angle})", f"{c}_cos_{i}")]
    return ", ".join(out)


@query("e14_periodic_features", with_sql(f"SELECT row_id, {_periodic_sql()} FROM counts"))
def periodic(spark, sf_dir):
    columns = encoders.periodic_features(_FREQ_COLUMNS, _FREQUENCIES)
    return rounded(counts(spark, sf_dir).select(ROW_ID, *columns))


@query(
    "j04_learned_scalars",
    with_sql(
        f"SELECT row_id, {r6('num_words - m', 'centred_words')}, {r6('p_a - mp', 'centred_score')}"
        f" FROM counts, (SELECT avg(num_words) AS m FROM {TRAIN}), (SELECT avg(p_a) AS mp FROM {TRAIN})",
        HOLDOUT_SQL,
    ),
)
def learned_scalars(spark, sf_dir):
    df = staged_counts(spark, sf_dir).select(ROW_ID, LABEL, "num_words", "p_a")
    train = part(holdout_split(df), "train")
    words, score = train.agg(F.avg("num_words"), F.avg("p_a")).first()
    return rounded(
        df.select(
            ROW_ID,
            (F.col("num_words") - F.lit(words)).alias("centred_words"),
            (F.col("p_a") - F.lit(score)).alias("centred_score"),
        )
    )
