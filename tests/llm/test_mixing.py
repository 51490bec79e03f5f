"""Raking against numpy, and the sample's shares against the targets."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import mixing as M

CELLS = [(s, l, t, float((i * 37) % 90 + 1)) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")]


def test_raked_margins_meet_targets(spark):
    got = M.raked(spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens double"), temper=0.5, rounds=30).collect()
    total = sum(c[3] for c in CELLS)
    for k, name in enumerate(M.MARGINS):
        own, have = Counter(), Counter()
        for r in got:
            own[r[name]] += r.tokens
            have[r[name]] += r.tokens * r.weight
        power = {v: (x / total) ** 0.5 for v, x in own.items()}
        for v in own:
            assert have[v] == pytest.approx(total * power[v] / sum(power.values()), rel=1e-6), (k, v)


def test_sample_and_odd_rows(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot" if i % 3 else f"s{i % 5}", "en" if i % 2 else "de") for i in range(4000)] + [(None, None, None, None), (5000, "", "only", "en"), (5001, "long " * 20_000, "hot", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"weight": F.lit("clash"), "total": F.lit(0)})
    got = M.mixed(docs).toPandas()
    assert len(got) == len(rows) and got.probability.between(0, 1).all() and got.probability.max() == 1
    share = lambda d, w: (d.assign(x=d.n_tokens * w).groupby("source").x.sum() / (d.n_tokens * w).sum()).fillna(0)
    want, have = share(got[got.source.notna()], got.weight), share(got[got.sampled & got.source.notna()], 1.0)
    assert np.abs(want - have.reindex(want.index).fillna(0)).max() < 0.03
    again = M.mixed(docs.repartition(7)).toPandas()
    assert set(again[again.sampled].doc_id.dropna()) == set(got[got.sampled].doc_id.dropna())
    assert M.mixed(docs.limit(0)).count() == 0


def test_many_cells_take_the_shuffled_way(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("source"), F.lit("en").alias("lang"))
    got = M.mixed(docs, rounds=2)
    assert got.count() == 3000 and got.where("probability IS NULL").count() == 0


def test_given_targets(spark):
    """Targets for two margins, one of which lacks a value; the third keeps its tempered shares."""
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens double")
    of = lambda rows: spark.createDataFrame(rows, "value string, share double")
    targets = {"source": of([("a", 1.0), ("b", 3.0), ("nowhere", 9.0)]), "lang": of([("x", 0.25), ("y", 0.75)])}
    got = M.raked(cells, targets=targets, rounds=200, tolerance=1e-9).collect()
    total = sum(c[3] for c in CELLS)
    share = lambda k, v: sum(r.tokens * r.weight for r in got if r[k] == v) / total
    assert [share("source", v) for v in "abc"] == pytest.approx([0.25, 0.75, 0.0], abs=1e-7)
    assert [share("lang", v) for v in "xy"] == pytest.approx([0.25, 0.75], abs=1e-7)
    fitted = spark.createDataFrame(got)
    errors = M.margin_errors(fitted, {"lang": targets["lang"]}).collect()
    assert len(errors) == 2 and all(abs(r.error) < 1e-7 for r in errors)
    docs = spark.createDataFrame([(i, "w w w", "abc"[i % 3], "xy"[i % 2], i) for i in range(600)], "doc_id long, text string, source string, lang string, cell int")
    out = M.mixed(docs, targets=targets).toPandas()
    assert not out[(out.source == "c") & out.sampled].size and out[out.source == "b"].sampled.sum() > 1.5 * out[out.source == "a"].sampled.sum()
    assert out.cell.tolist() == out.doc_id.tolist()


def test_sums_by_the_driver_and_by_joins_are_one(spark, monkeypatch):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens double")
    fit = lambda: {(r.source, r.lang, r.topic): r.weight for r in M.raked(cells, temper=0.5).collect()}
    want = fit()
    monkeypatch.setattr(M, "SMALL", 0)
    assert fit() == pytest.approx(want, rel=1e-12)


def test_budget_repeats_scarce_sources(spark):
    """Half the tokens of a source of 20 texts, half of one of 19,980: probability alone would sample some 40."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 20, "scarce").otherwise("rich").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("repeats"))
    targets = {"source": spark.createDataFrame([("scarce", 0.5), ("rich", 0.5)], "value string, share double")}
    got = M.mixed(docs, targets=targets, budget=40_000).where("sampled")
    by = {r.source: r.n for r in got.groupBy("source").agg((F.sum("repeats") * 4).alias("n")).collect()}
    assert by["scarce"] == pytest.approx(20_000, rel=0.01) and by["rich"] == pytest.approx(20_000, rel=0.05)
    rows = M.repeated(got)
    assert rows.count() * 4 == sum(by.values()) and rows.groupBy("doc_id", "repeat").count().where("count > 1").count() == 0
    assert rows.agg(F.min("repeat")).first()[0] == 1
    assert M.mixed(docs.withColumn("text", F.lit(None).cast("string")), budget=10).where("sampled").count() == 0
    assert M.repeated(M.mixed(docs.limit(0), budget=10)).count() == 0
