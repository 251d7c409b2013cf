import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.operators import encoders, features, lookup, splits, woe
from rareflow.schema import COUNT_COLUMNS, LABEL, ROW_ID
from rareflow.sources import tables, validation


def test_catalogue_width_and_order(counts):
    frame = counts.select(ROW_ID, *COUNT_COLUMNS)
    out = features.FeatureEngineer().fit(frame).transform(frame)
    assert out.columns[: len(COUNT_COLUMNS) + 1] == frame.columns
    assert len(out.columns) == 1 + 60
    derived = features.FeatureEngineer(keep_raw=False).fit(frame).transform(frame)
    assert len(derived.columns) == 1 + 52
    no_email = features.FeatureEngineer(add_logz_email=False).fit(frame).transform(frame)
    assert "logz_num_email_addresses" not in no_email.columns


@pytest.mark.parametrize("eps", [0.0, 1.0])
def test_zero_rows_stay_finite(spark, eps):
    rows = [(0,) * 8, (0, 0, 5, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in COUNT_COLUMNS))
    out = features.FeatureEngineer(eps=eps).fit(df).transform(df)
    for r in out.collect():
        assert all(math.isfinite(v) for v in r)


def test_missing_columns_drop_their_features_only(spark):
    df = spark.createDataFrame([(3, 1)], "num_links long, num_words long")
    out = features.FeatureEngineer().fit(df).transform(df)
    assert {"has_links", "link_density", "high_link_density"} <= set(out.columns)
    assert "has_emails" not in out.columns and "domain_per_link_ratio" not in out.columns


def test_interaction_products(spark):
    df = spark.createDataFrame([(1, 4, 0), (2, 5, 1), (3, 6, 0)], "a int, b int, c int")
    out = features.add_interactions(df, ["a", "b", "c"])
    assert out.columns == ["a", "b", "c", "a__x__b", "a__x__c", "b__x__c"]
    assert [r["a__x__b"] for r in out.orderBy("a").collect()] == [4, 10, 18]


def test_split_is_exact_and_independent_of_partitioning(counts):
    few = splits.holdout_split(counts.coalesce(1))
    many = splits.holdout_split(counts.repartition(16))
    pick = lambda d: {r[ROW_ID]: r["split"] for r in d.select(ROW_ID, "split").collect()}
    assert pick(few) == pick(many)
    n = counts.count()
    sizes = {r["split"]: r["n_rows"] for r in splits.positive_rates(few).collect()}
    assert sizes["val"] == math.ceil(0.05 * n)
    assert sizes["test"] == math.ceil(0.2 * (n - sizes["val"]))
    other = splits.holdout_split(counts, seed=7)
    assert pick(other) != pick(few)


def test_folds_cover_every_row_once(counts):
    rows = splits.assign_folds(counts, 5).groupBy(LABEL, "fold").count().collect()
    for k in (0, 1):
        sizes = [r["count"] for r in rows if r[LABEL] == k]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in rows) == counts.count()


def test_sample_keeps_class_shares(counts):
    n = counts.count()
    by_class = {r[LABEL]: r["count"] for r in counts.groupBy(LABEL).count().collect()}
    got = splits.stratified_sample(counts, 500).groupBy(LABEL).count().collect()
    assert {r[LABEL]: r["count"] for r in got} == {k: round(500 / n * c) for k, c in by_class.items()}
    assert splits.stratified_sample(counts, n).count() == n


def test_quotas_sum_to_the_total():
    for total in range(0, 30):
        assert sum(splits.class_quotas({0: 23, 1: 6}, total).values()) == total


def test_unlabelled_split_is_an_error(counts):
    with pytest.raises(ValueError):
        splits.holdout_split(counts.drop(LABEL))


def test_out_of_fold_value_ignores_the_rows_own_label(spark):
    rows = [(i, i % 3, i % 5, int(i % 7 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, f"row_id int, v int, fold int, {LABEL} int")
    base = encoders.CrossFitTargetEncoder().fit(df, ["v"])
    got = {r[ROW_ID]: r["v_te"] for r in base.transform_train(df).collect()}
    prior = sum(r[3] for r in rows) / len(rows)
    for i, v, fold, _ in rows:
        others = [y for _, w, f, y in rows if w == v and f != fold]
        want = (sum(others) + prior * 20) / (len(others) + 20)
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_unseen_value_gets_the_prior(spark):
    train = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], f"v int, {LABEL} int")
    fitted = encoders.CrossFitTargetEncoder().fit(train, ["v"])
    new = spark.createDataFrame([(9,), (None,)], "v int")
    assert [r["v_te"] for r in fitted.transform(new).collect()] == [pytest.approx(1 / 3)] * 2


def test_lookup_paths_agree_on_skewed_keys(spark):
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 97 == 1, None).otherwise(F.col("id") % 400).alias("k"),
    )
    table = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.avg("id").alias("m"))
    table = table.filter(F.col("k") % 11 != 5)
    small = lookup.attach(df, table, ["k"], ["m"], "n")
    large = lookup.attach(df, table, ["k"], ["m"], "n", broadcast_rows=10)
    want = {r["id"]: (r["k"], r["m"]) for r in small.collect()}
    got = {r["id"]: (r["k"], r["m"]) for r in large.collect()}
    assert got == want and len(got) == 3000


def test_lookup_paths_agree_on_signed_zero_and_equal_rows(spark):
    df = spark.createDataFrame([(v,) for v in [-0.0, 0.0, 1.5, 1.5, 1.5, None, float("nan")]], "k double")
    table = spark.createDataFrame([(0.0, 2, 7.0), (1.5, 3, 8.0), (float("nan"), 1, 9.0)], "k double, n long, m double")
    told = lambda rows: sorted((str(r["k"]).lstrip("-"), r["m"]) for r in lookup.attach(df, table, ["k"], ["m"], "n", broadcast_rows=rows).collect())
    assert told(100) == told(1) == sorted(
        [("0.0", 7.0)] * 2 + [("1.5", 8.0)] * 3 + [("None", None), ("nan", 9.0)], key=lambda x: x
    )


@pytest.mark.parametrize("partitions", ["1", "3", "4", "8"])
def test_folder_of_files_does_not_depend_on_shuffle_partitions(spark, partitions):
    from conftest import SMALL

    from rareflow.catalog import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert QUERIES["s05_folder_rows"](spark, SMALL).first()["n_files"] == 4
        assert QUERIES["s05_list_folder"](spark, SMALL).first()["n_files"] == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_target_means_keep_values_apart(spark):
    """Long integers beyond doubles, strings, and signed zeros, which are one value."""
    big = 2**53
    rows = [(big, "a", -0.0, 1), (big + 1, "b", 0.0, 0), (big + 1, "b", 1.0, 0), (None, None, None, 1)]
    train = spark.createDataFrame(rows, f"i long, s string, d double, {LABEL} int")
    fitted = encoders.CrossFitTargetEncoder(smoothing=0.0).fit(train, ["i", "s", "d"])
    got = [tuple(r) for r in fitted.transform(train).select("i_te", "s_te", "d_te").collect()]
    assert sorted(got) == sorted([(1.0, 1.0, 0.5), (0.0, 0.0, 0.5), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5)])
    assert len(fitted.maps) == 1
    fitted.transform(train)
    assert len(fitted.maps) == 1


def test_smoothing_leaves_flags_alone(counts):
    frame = counts.select(ROW_ID, *COUNT_COLUMNS)
    engineered = features.FeatureEngineer().fit(frame).transform(frame)
    flags = [c for c in engineered.columns if c.startswith("has_")]
    names = [c for c in engineered.columns if c != ROW_ID]
    out = encoders.FeatureSmoothing().fit(engineered, names).transform(engineered)
    assert out.columns == engineered.columns
    total = lambda d: d.agg(*[F.sum(c) for c in flags]).first()
    assert total(out) == total(engineered)
    low, high = out.agg(F.min("num_words"), F.max("num_words")).first()
    assert low >= 0.0 and high <= 1.0


def test_uniform_ranks_follow_interpolation(spark):
    train = spark.createDataFrame([(float(v),) for v in [0] * 6 + [1, 2, 3, 4]], "x double")
    fitted = encoders.FeatureSmoothing(lower=0.0, upper=1.0).fit(train, ["x"])
    refs = np.array(fitted.references["x"])
    level = np.linspace(0, 1, len(refs))
    for r in fitted.transform(train.withColumn("raw", F.col("x"))).collect():
        x = r["raw"]
        want = 0.5 * (np.interp(x, refs, level) - np.interp(-x, -refs[::-1], -level[::-1]))
        want = 1.0 if x >= refs[-1] else 0.0 if x <= refs[0] else want
        assert r["x"] == pytest.approx(want)


def test_binner_drops_collapsed_edges(spark):
    df = spark.createDataFrame([(0.0,)] * 90 + [(float(i),) for i in range(1, 11)], "x double")
    fitted = encoders.QuantileBinner().fit(df, ["x"])
    edges = fitted.edges["x"]
    assert edges == sorted(set(edges)) and len(edges) < 9
    wide = spark.createDataFrame([(-5.0,), (99.0,)], "x double")
    assert [r["x_bin"] for r in fitted.transform(wide).collect()] == [0, len(edges) - 2]


def best_by_hand(counts, max_bins, share):
    """All contiguous merges, monotone ones first."""
    from itertools import combinations

    all_n, all_e = sum(n for n, _ in counts), sum(e for _, e in counts)
    results = {True: [], False: []}
    for size in range(max_bins):
        for inner in combinations(range(1, len(counts)), size):
            edges = [0, *inner, len(counts)]
            parts = [
                (sum(n for n, _ in counts[a:b]), sum(e for _, e in counts[a:b]))
                for a, b in zip(edges, edges[1:])
            ]
            if any(e == 0 or e == n or n < share * all_n for n, e in parts):
                continue
            iv = sum(
                ((n - e) / (all_n - all_e) - e / all_e)
                * math.log((n - e) / (all_n - all_e) / (e / all_e))
                for n, e in parts
            )
            rates = [e / n for n, e in parts]
            ordered = all(a < b for a, b in zip(rates, rates[1:])) or all(
                a > b for a, b in zip(rates, rates[1:])
            )
            results[ordered].append((iv, edges[:-1]))
    return max(results[True] or results[False])


def test_bin_merge_finds_the_optimum():
    counts = [(50, 1), (40, 4), (30, 2), (60, 0), (20, 6), (35, 9), (5, 1), (60, 20)]
    value, starts = best_by_hand(counts, 4, 0.05)
    assert woe.merge_bins(counts, 4, 0.05) == starts


def test_binning_is_finite_and_bounded(counts):
    fitted = woe.OptimalBinningWOE().fit(counts, COUNT_COLUMNS)
    for c in COUNT_COLUMNS:
        assert 1 <= len(fitted.values[c]) <= 8
        assert len(fitted.cuts[c]) == len(fitted.values[c]) - 1
        assert all(math.isfinite(v) for v in fitted.values[c])


def test_rejected_rows_name_their_reason(counts):
    bad = counts.select(*COUNT_COLUMNS).limit(1).withColumn("num_links", F.lit(-1).cast("bigint"))
    valid, rejected = validation.split_valid(bad)
    assert valid.count() == 0 and rejected.first()["reason"] == "negative:num_links"
    with pytest.raises(ValueError):
        validation.with_reason(bad.drop("num_words"))
    with pytest.raises(ValueError):
        validation.require_rows(valid)


def test_reader_round_trip(spark, counts, tmp_path):
    plain = counts.drop("p_a", "p_b")
    plain.write.option("header", True).csv(str(tmp_path / "c"))
    read = tables.load_counts(spark, str(tmp_path / "c"))
    assert read.exceptAll(plain).count() == 0 and read.count() == plain.count()
    listed = tables.list_folder(spark, str(tmp_path / "c"))
    assert listed.count() >= 1 and listed.agg(F.min("n_bytes")).first()[0] > 0
    assert tables.feature_frame(plain).columns == COUNT_COLUMNS
    other = spark.createDataFrame([(1, 2)], "x int, label_1 int")
    assert tables.feature_frame(other).columns == ["x", "label_1"]
    assert tables.features_and_label(other).columns == ["x", "label_1"]


def test_large_target_maps_share_one_join(spark, monkeypatch):
    """Maps above the broadcast room: same values as broadcast ones, one lookup join for all columns."""
    rows = spark.range(4000).select(
        F.col("id").alias("row_id"),
        *[
            F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 17 == 0, None).otherwise(F.col("id") % (50 + i)).alias(f"c{i}")
            for i in range(4)
        ],
        (F.col("id") % 40 / 8).alias("d"),
        F.concat(F.lit("s"), F.col("id") % 90).alias("s"),
        (F.col("id") % 13 == 0).cast("int").alias(LABEL),
        (F.col("id") % 5).cast("int").alias("fold"),
        F.lit("kept").alias("n"),
    )
    names = ["c0", "c1", "c2", "c3", "d", "s"]
    fitted = encoders.CrossFitTargetEncoder().fit(rows, names)
    told = lambda df: sorted(map(str, df.collect()))
    small = told(fitted.transform(rows)), told(fitted.transform_train(rows))
    unseen = rows.withColumn("c0", F.col("c0") + 1_000).withColumn("s", F.lit(None).cast("string"))
    want = told(fitted.transform(unseen))
    monkeypatch.setattr(encoders, "BROADCAST_ROWS", 12)
    large = fitted.transform(rows)
    assert told(large) == small[0]
    assert told(fitted.transform_train(rows)) == small[1]
    assert told(fitted.transform(unseen)) == want
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    lookups = [line for line in plan.splitlines() if "Join" in line and "_cell" in line and "broadcast" not in line]
    assert len(lookups) == 1
    assert fitted.transform(rows.limit(0)).count() == 0
