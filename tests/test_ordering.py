"""Order statistics on skewed data: one group, and one value, hold most of the rows."""

import numpy as np
import pandas as pd
import pytest

from askspark.operators.ordering import exact_percentiles, exact_ranks
from askspark.operators.relational import rank_in_group


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 6000
    frame = pd.DataFrame({
        "g": rng.choice(["hot", "warm", None], n, p=[0.8, 0.15, 0.05]),
        "v": np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(0, 50, n), 1)),
        "id": np.arange(n),
    })
    frame.loc[rng.random(n) < 0.05, "v"] = np.nan
    return frame


def to_spark(spark, frame):
    rows = [(g, None if pd.isna(v) else float(v), int(i)) for g, v, i in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, v double, id bigint")


@pytest.mark.parametrize("descending", [True, False])
def test_ranks(spark, skewed, descending):
    got = exact_ranks(to_spark(spark, skewed), ["g"], "v", "id", descending).toPandas().sort_values("id")
    keyed = skewed.assign(g=skewed.g.fillna("?"))
    order = keyed.sort_values(["v", "id"], ascending=[not descending, True], na_position="last")
    number = order.groupby("g").cumcount() + 1
    filled = keyed.assign(v=keyed.v.fillna(-1e9 if descending else 1e9)).groupby("g").v
    assert (got.row_number.to_numpy() == number.sort_index().to_numpy()).all()
    assert (got["rank"].to_numpy() == filled.rank("min", ascending=not descending).to_numpy()).all()
    assert (got.dense_rank.to_numpy() == filled.rank("dense", ascending=not descending).to_numpy()).all()


def test_cut_agrees_with_full_ranking(spark, skewed):
    df = to_spark(spark, skewed)
    full = exact_ranks(df, ["g"], "v", "id").where("row_number <= 20")
    cut = rank_in_group(df, ["g"], "v", "id", k=20)
    assert sorted(map(tuple, full.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


def test_percentiles(spark, skewed):
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_percentiles(to_spark(spark, skewed), ["g"], "v", probs).toPandas()
    for name, part in skewed.assign(g=skewed.g.fillna("?")).groupby("g"):
        row = got[got.g.fillna("?") == name].iloc[0]
        for column, p in probs.items():
            assert row[column] == pytest.approx(part.v.quantile(p), abs=1e-9)


def test_without_keys_and_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert exact_percentiles(df, [], "v", {"m": 0.5}).first()["m"] == 1.5
    nothing = spark.createDataFrame([], "g string, v double, id bigint")
    assert exact_ranks(nothing, ["g"], "v", "id").count() == 0


@pytest.mark.parametrize("descending", [True, False])
def test_text_ranks_with_a_common_prefix(spark, descending):
    """Texts that share their first bytes, with one hot text and one hot group: pieces stay small and ranks exact."""
    rng = np.random.default_rng(3)
    n = 8000
    names = [None if x == 0 else f"Customer#{x:09d}" for x in np.where(rng.random(n) < 0.5, 77, rng.integers(0, 400, n))]
    frame = pd.DataFrame({"g": rng.choice(["hot", "cold"], n, p=[0.9, 0.1]), "v": names, "id": [f"https://host/{i:08d}" for i in rng.permutation(n)]})
    df = spark.createDataFrame(list(frame.itertuples(index=False, name=None)), "g string, v string, id string")
    got = exact_ranks(df, ["g"], "v", "id", descending, ranges=16).toPandas().set_index("id")
    for _, group in frame.groupby("g"):
        known = sorted({v for v in group.v if v is not None}, reverse=descending)
        dense = {v: i + 1 for i, v in enumerate([*known, None])}
        rows = sorted((dense[v], i) for v, i in zip(group.v, group.id))
        starts = {}
        for at, (d, i) in enumerate(rows, 1):
            starts.setdefault(d, at)
            assert tuple(got.loc[i, ["row_number", "rank", "dense_rank"]]) == (at, starts[d], d)


def test_no_task_holds_a_hot_text(spark):
    df = spark.range(20000).selectExpr("'g' AS g", "'Customer#1' AS v", "concat('https://host/', lpad(id, 9, '0')) AS id")
    ranked = exact_ranks(df, ["g"], "v", "id", ranges=20)
    assert ranked.where("rank = 1 AND dense_rank = 1").count() == 20000
    (stored,) = {f.rsplit("/", 1)[0] for f in ranked.inputFiles()}
    sizes = [r["count"] for r in spark.read.parquet(stored).groupBy("__range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3000
