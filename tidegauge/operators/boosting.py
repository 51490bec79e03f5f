"""Multi-class gradient boosting of second order over histograms, as an estimator of spark.ml, with early stopping.

Features are binned by their quantiles once. A round grows a tree a class, all level by level together: one aggregation sums
gradients and Hessians of the softmax loss by class, node, feature and bin, combined before the shuffle, and another finds
each node's best cut from these sums, whose number hangs on classes, nodes, features and bins only. Trees are all that reaches
the driver. Rows keep their bins and margins; a round's trees move the margins, as expressions over the bins.

With heldOut, the last share of rows by orderCol (a stretch of time) teaches nothing: its loss is taken after every round, and
boosting stops when it hasn't fallen for patience rounds; the model keeps the rounds up to its least loss.

A null or NaN feature is less than any cut. Rows without a label are passed over; labels are 0 to k - 1.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import settled

#: Rounds after which rows are written down, which cuts their lineage.
CUT = 10


def quantile_edges(df: DataFrame, x: str, d: int, bins: int) -> list[list[float]]:
    """Distinct cuts between bins of about equal numbers of rows, for each of the d entries of an array column; nulls and NaN don't count."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    entry = lambda i: F.when(~F.isnan(F.get(x, F.lit(i))), F.get(x, F.lit(i)))
    row = df.agg(*[F.percentile_approx(entry(i), at, 10_000).alias(f"f{i}") for i in range(d)]).first()
    return [sorted(set(row[i] or [])) for i in range(d)]


def binned(x: str, edges: list[list[float]]) -> Column:
    """An array of the numbers of bins: 0 for null or NaN, else 1 and how many cuts the entry is above."""

    def one(i: int, cuts: list[float]) -> Column:
        v = F.get(x, F.lit(i))
        above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < v)) if cuts else F.lit(0)
        return F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + above)

    return F.array(*[one(i, cuts) for i, cuts in enumerate(edges)])


def softmax(m: Column) -> Column:
    e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))


def sums(rows: DataFrame, nodes: list[Column], k: int) -> DataFrame:
    """c, node, f, b, g, h: sums of gradients and Hessians of rows with bins, y and m (margins), by class, node, feature and bin; rows whose node is null aren't in it."""
    p = rows.withColumn("p", softmax(F.col("m")))
    prob = lambda c: F.get("p", F.lit(c))
    each = F.array(*[F.struct(F.lit(c).alias("c"), nodes[c].cast("int").alias("node"), (prob(c) - (F.col("y") == c).cast("double")).alias("g"), (prob(c) * (1 - prob(c))).alias("h")) for c in range(k)])
    p = p.select("bins", F.explode(each).alias("e")).where("e.node IS NOT NULL").select("e.*", F.posexplode("bins").alias("f", "b"))
    return p.groupBy("c", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def gains(of_bins: DataFrame, l2: float = 1.0, least: float = 1.0) -> DataFrame:
    """of_bins with gl, hl (sums up to the bin), gt, ht (of the node) and gain of a cut after the bin; null where a side has a Hessian under least."""
    w = Window.partitionBy("c", "node", "f")
    upto = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    out = of_bins.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "gt": F.sum("g").over(w), "ht": F.sum("h").over(w)})
    part = lambda g, h: g * g / (h + l2)
    g, h, gt, ht = (F.col(c) for c in ("gl", "hl", "gt", "ht"))
    gain = 0.5 * (part(g, h) + part(gt - g, ht - h) - part(gt, ht))
    return out.withColumn("gain", F.when((h >= least) & (ht - h >= least), gain))


def best_cuts(of_bins: DataFrame, l2: float, least: float, able: Column) -> DataFrame:
    """One row a class and node: gt, ht, and f, b, gl, hl, gain of the best cut of features that are able; ties go to the first feature and bin. The sums, a bounded table, are one task's, so that they are shuffled once only."""
    cut = F.when(able & (F.col("gain") > 1e-9), F.struct(F.round("gain", 9).alias("top"), (-F.col("f")).alias("nf"), (-F.col("b")).alias("nb"), "gl", "hl"))
    got = gains(of_bins.coalesce(1), l2, least).groupBy("c", "node").agg(F.first("gt").alias("gt"), F.first("ht").alias("ht"), F.max(cut).alias("cut"))
    return got.select("c", "node", "gt", "ht", (-F.col("cut.nf")).alias("f"), (-F.col("cut.nb")).alias("b"), "cut.gl", "cut.hl", F.col("cut.top").alias("gain"))


#: A tree: {node: [feature, bin, gain, Hessian]} for cuts and {node: [value, Hessian]} for leaves; the root is 1, n has 2n (at most the bin) and 2n + 1.
Tree = dict


def _array(values: list, kind: str) -> Column:
    """A constant array, told in one piece: a call of the JVM for each value would take longer than a level."""
    return F.expr(f"CAST(array({', '.join('NULL' if v is None else f'{v!r}D' if kind == 'double' else str(v) for v in values)}) AS array<{kind}>)")


def routed(tree: Tree, depth: int) -> Column:
    """The node that a row with bins ends at."""
    cut = lambda n, i, otherwise: tree[n][i] if len(tree.get(n, ())) == 4 else otherwise
    feature, at = (_array([cut(n, i, -1) for n in range(2**depth)], "int") for i in (0, 1))

    def step(node: Column, _: Column) -> Column:
        f = F.get(feature, node)
        return F.when(f >= 0, 2 * node + (F.get("bins", f) > F.get(at, node)).cast("int")).otherwise(node)

    return F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(1), step)


class _Boosting(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    pass


class HistogramBoosting(Estimator, _Boosting, HasMaxIter, HasStepSize, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """maxIter rounds of trees of maxDepth; see the module."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of cuts of a tree", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to Hessians of values and gains", TypeConverters.toFloat)
    leastHessian = Param(Params._dummy(), "leastHessian", "sum of Hessians of a node at least", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows that a round learns from", TypeConverters.toFloat)
    columns = Param(Params._dummy(), "columns", "share of features that a tree may cut", TypeConverters.toFloat)
    orderCol = Param(Params._dummy(), "orderCol", "column of time, whose last stretch is held out", TypeConverters.toString)
    heldOut = Param(Params._dummy(), "heldOut", "share of rows held out, 0 for none", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "rounds without a lesser loss before it stops", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction", maxIter=100, stepSize=0.1, seed=42, maxDepth=6, bins=32, l2=1.0, leastHessian=1.0, subsample=1.0, columns=1.0, orderCol="ts", heldOut=0.0, patience=10):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, seed=42, maxDepth=6, bins=32, l2=1.0, leastHessian=1.0, subsample=1.0, columns=1.0, orderCol="ts", heldOut=0.0, patience=10)
        self._set(**self._input_kwargs)

    def _prepared(self, df: DataFrame) -> tuple[DataFrame, list[list[float]], int]:
        """Rows with bins, y, held (out) and u, a number that differs between rows; the cuts and the number of classes."""
        share, order = self.getOrDefault(self.heldOut), self.getOrDefault(self.orderCol)
        at = F.unix_micros(F.col(order).cast("timestamp")).cast("double") if share else F.lit(0.0)
        rows = df.where(F.col(self.getLabelCol()).isNotNull()).select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"), at.alias("at"))
        told = rows.agg(F.max("y").alias("k"), F.max(F.size("x")).alias("d"), F.percentile_approx("at", F.lit(1 - share), 10_000).alias("edge")).first()
        if told.k is None:
            raise ValueError("no row has a label")
        rows = rows.withColumn("held", F.col("at") > told.edge if share else F.lit(False))
        edges = quantile_edges(rows.where("NOT held"), "x", told.d, self.getOrDefault(self.bins))
        return rows.select(binned("x", edges).alias("bins"), "y", "held", F.xxhash64("x", "at", "y").alias("u")), edges, told.k + 1

    def _fit(self, df: DataFrame) -> HistogramBoostingModel:
        rows, edges, k = self._prepared(df)
        of = self.getOrDefault
        rate, depth, rng = self.getStepSize(), of(self.maxDepth), np.random.default_rng(self.getSeed())
        rows = settled(rows.withColumn("m", F.array(*[F.lit(0.0)] * k)), "boosting")
        done: list[list[Tree]] = []
        losses: list[float] = []
        before = rows
        for nth in range(self.getMaxIter()):
            drawn = rows.where("NOT held")
            if of(self.subsample) < 1:
                drawn = drawn.where(F.pmod(F.xxhash64("u", F.lit(nth)), F.lit(1_000_000)) < int(1_000_000 * of(self.subsample)))
            wide = max(1, math.ceil(of(self.columns) * len(edges)))
            able = [sorted(int(f) for f in rng.choice(len(edges), wide, replace=False)) for _ in range(k)]
            trees = self._grown(drawn, k, depth, able, rate)
            done.append(trees)
            value = lambda c: F.get(_array([float(trees[c][n][0]) if len(trees[c].get(n, ())) == 2 else 0.0 for n in range(2 ** (depth + 1))], "double"), routed(trees[c], depth))  # noqa: B023, E731
            moved = rows.withColumn("m", F.array(*[F.get("m", F.lit(c)) + value(c) for c in range(k)]))
            before, rows = rows, (settled(moved, "boosting") if (nth + 1) % CUT == 0 else moved.persist())
            if of(self.heldOut):
                loss = rows.where("held").agg(F.avg(-F.ln(F.greatest(F.get(softmax(F.col("m")), F.col("y")), F.lit(1e-15))))).first()[0]
                losses.append(math.inf if loss is None else loss)
                if len(losses) - 1 - int(np.argmin(losses)) >= of(self.patience):
                    break
            elif not any(len(v) == 4 for t in trees for v in t.values()):
                break  # nothing is left to cut
            if before.is_cached:
                if not of(self.heldOut):  # else the loss has read all of them
                    rows.count()
                before.unpersist()
        for left in (rows, before):
            if left.is_cached:
                left.unpersist()
        kept = done[: int(np.argmin(losses)) + 1] if losses else done
        state = {"k": k, "edges": edges, "losses": losses, "rounds": [[{str(n): v for n, v in t.items()} for t in trees] for trees in kept]}
        return self._copyValues(HistogramBoostingModel(state=json.dumps(state)))

    def _grown(self, rows: DataFrame, k: int, depth: int, able: list[list[int]], rate: float) -> list[Tree]:
        """A tree for each class."""
        l2, least = self.getOrDefault(self.l2), self.getOrDefault(self.leastHessian)
        value = lambda g, h: [-rate * g / (h + l2), h]
        trees: list[Tree] = [{} for _ in range(k)]
        may = reduce(lambda a, b: a | b, [(F.col("c") == c) & F.col("f").isin(able[c]) for c in range(k)])
        for level in range(depth):
            waits = lambda c, n: n if (n == 1 if level == 0 else 2**level <= n and trees[c].get(n, [0])[0] is None) else None  # noqa: B023, E731
            open_ = lambda c: F.get(_array([waits(c, n) for n in range(2 ** (depth + 1))], "int"), routed(trees[c], depth))  # noqa: B023, E731
            got = best_cuts(sums(rows, [open_(c) for c in range(k)], k), l2, least, may).collect()  # a row a class and open node
            for r in got:
                if r.f is None:
                    trees[r.c][r.node] = value(r.gt, r.ht)
                    continue
                trees[r.c][r.node] = [r.f, r.b, r.gain, r.ht]
                for child, g, h in ((2 * r.node, r.gl, r.hl), (2 * r.node + 1, r.gt - r.gl, r.ht - r.hl)):
                    trees[r.c][child] = value(g, h) if level + 1 == depth else [None, *value(g, h)]
            if not any(r.f is not None for r in got):
                break
        for t in trees:
            t.setdefault(1, [0.0, 0.0])
            for n, v in t.items():
                if v[0] is None:
                    t[n] = v[1:]
        return trees


class HistogramBoostingModel(Model, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Trees as a parameter, so that it is saved, copied and read again like any other."""

    state = Param(Params._dummy(), "state", "classes, cuts, rounds of trees and losses of the held-out stretch, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def told(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def rounds(self) -> int:
        return len(self.told["rounds"])

    @property
    def losses(self) -> list[float]:
        return self.told["losses"]

    def importances(self, kind: str = "gain") -> dict[int, float]:
        """Of each feature: weight (cuts), gain or cover (their mean gain, or mean Hessian), as shares of 1."""
        total, n = np.zeros((2, len(self.told["edges"])))
        for v in (v for trees in self.told["rounds"] for t in trees for v in t.values() if len(v) == 4):
            total[v[0]] += {"weight": 1.0, "gain": v[2], "cover": v[3]}[kind]
            n[v[0]] += 1
        mean = total if kind == "weight" else total / np.maximum(n, 1)
        return dict(enumerate((mean / (mean.sum() or 1.0)).tolist()))

    def tree_rows(self) -> list[tuple]:
        """(round, class, node, feature, cut, gain, Hessian, value) of each node."""
        out, edges = [], self.told["edges"]
        for i, trees in enumerate(self.told["rounds"]):
            for c, t in enumerate(trees):
                for n, v in t.items():
                    cut = len(v) == 4
                    out.append((i, c, int(n), v[0] if cut else None, _threshold(edges, v) if cut else None, v[2] if cut else None, v[-1], None if cut else v[0]))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        told = self.told
        k, size = told["k"], 2 * max((int(n) for trees in told["rounds"] for t in trees for n in t), default=1) + 2
        flat = []
        for trees in told["rounds"]:
            for c, t in enumerate(trees):
                feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
                for n, v in t.items():
                    if len(v) == 4:
                        feature[int(n)], cut[int(n)] = v[0], _threshold(told["edges"], v)
                    else:
                        value[int(n)] = v[0]
                flat.append((c, feature, cut, value))

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            rows = np.array([np.asarray(v, float) for v in x]) if len(x) else np.zeros((0, 1))
            out, every = np.zeros((len(rows), k)), np.arange(len(rows))
            for c, feature, cut, value in flat:
                node = np.ones(len(rows), int)
                while (on := feature[node] >= 0).any():
                    at = node[on]
                    node[on] = 2 * at + (rows[every[on], feature[at]] > cut[at])  # NaN isn't above
                out[:, c] += value[node]
            return pd.Series(list(out))

        raw, p, y = self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()
        df = df.withColumn(raw, margins(vector_to_array(self.getFeaturesCol())))
        df = df.withColumn(p, softmax(F.col(raw)))
        df = df.withColumn(y, (F.array_position(p, F.array_max(p)) - 1).cast("double"))
        return df.withColumns({raw: array_to_vector(raw), p: array_to_vector(p)})


def _threshold(edges: list[list[float]], cut: list) -> float:
    """The value that rows to the left aren't above; bin 0 has only nulls, which are less than any."""
    f, b = cut[:2]
    return edges[f][b - 1] if b else -math.inf
