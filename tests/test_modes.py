"""Queries of feature modes: the recipe's own settings."""

from pyspark.sql import functions as F

from rareflow.catalog import QUERIES
from rareflow.catalog import learners as queries
from rareflow.operators.latent import HiddenLayerEmbedding
from rareflow.schema import LABEL, ROW_ID


def test_mode_trains_its_net_to_the_end(spark, monkeypatch):
    """The query of a mode asks for the net's own number of steps."""
    rows = [(i, i % 5, i % 7, int(i % 9 == 0), s) for i, s in enumerate(["train", "train", "val", "test"] * 20)]
    data = spark.createDataFrame(rows, f"{ROW_ID} long, {queries.FEATURES[0]} long, {queries.FEATURES[1]} long, {LABEL} int, split string")
    data = data.withColumns({c: F.lit(0).cast("long") for c in queries.FEATURES[2:]})
    monkeypatch.setattr(queries, "_split_table", lambda *_: data)
    asked, fit = [], HiddenLayerEmbedding.fit

    def short(self, *args):
        asked.append(self.max_iter)
        self.max_iter = 5
        return fit(self, *args)

    monkeypatch.setattr(HiddenLayerEmbedding, "fit", short)
    assert QUERIES["e16_engineered_nnembed"](spark, "").count() == 80
    assert set(asked) == {HiddenLayerEmbedding().max_iter}
