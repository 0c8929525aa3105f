"""Statistical learning on DataFrames: scaling, components, clusters, regression, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.agg import ranked
from strandline.operators.graph import components as linked
from strandline.operators.metric import Cells
from strandline.operators.metric import near as within_eps
from strandline.operators.vectors import mean_vector
from strandline.storage import Scratch


def standardise(df: DataFrame, vector: str, name: str = "scaled") -> DataFrame:
    """Elements less their mean over their population deviation; a constant element is only centred."""
    long = df.select(F.posexplode(vector).alias("_pos", "_v")).groupBy("_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.stddev_pop(F.col("_v").cast("double")).alias("_s"))
    one = long.agg(F.sort_array(F.collect_list(F.struct("_pos", "_m", "_s"))).alias("_z"))  # one row: an entry per element
    z = F.zip_with(vector, "_z", lambda x, m: (x.cast("double") - m["_m"]) / F.when(m["_s"] > 0, m["_s"]).otherwise(1.0))
    return df.crossJoin(F.broadcast(one)).withColumn(name, z).drop("_z")


def components(df: DataFrame, vector: str, k: int, name: str = "pca") -> DataFrame:
    """The first k principal components; the input is centred first."""
    centre = mean_vector(df.withColumn("_a", F.lit(0)), "_a", vector, "_m").select("_m")  # one row, a vector
    c = df.crossJoin(F.broadcast(centre)).withColumn("_v", array_to_vector(F.zip_with(vector, "_m", lambda x, m: x.cast("double") - m))).drop("_m")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(c)
    return model.transform(c).withColumn(name, vector_to_array("_p")).drop("_v", "_p")


def clusters(df: DataFrame, vector: str, k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    d = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name).fit(d).transform(d).drop("_v")


def logistic(df: DataFrame, vector: str, label: str, weight: str, c: float = 0.1, name: str = "prob") -> DataFrame:
    """L2 logistic regression with inverse strength c over the weighted sum; adds the positive class's probability."""
    d = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    total = d.agg(F.sum(weight)).first()[0]
    fit = LogisticRegression(featuresCol="_v", labelCol=label, weightCol=weight, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y")
    return fit.fit(d).transform(d).withColumn(name, F.get(vector_to_array("_p"), F.lit(1))).drop("_v", "_p", "_r", "_y")


class Forest:
    """Links between nodes that were not connected by earlier ones."""

    def __init__(self):
        self.above, self.kept = {}, []

    def _root(self, x: object) -> object:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, a: object, b: object) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.above[y] = x
            self.kept.append((a, b))

    def links(self) -> tuple[list, list]:
        return [a for a, _ in self.kept], [b for _, b in self.kept]


def dbscan(df: DataFrame, row: str, vector: str, eps: float, least: int, block: int = 4096) -> DataFrame:
    """(row, cluster) by whole vectors: clusters of core points within eps of each other, named by their least row id; -1 is noise.

    A core point has ``least`` points within eps, itself included; border points take the least
    neighbouring cluster. Points ask the blocks of pivot cells that may hold points within eps of them;
    blocks are read, not shuffled. A call returns a count for each point, then links that join what is
    connected (no more than its points), then the border's clusters, never the pairs. So dense or equal
    points cost time but no output; time grows with the square of the points that share a cell's surroundings. Rows
    without a vector are noise. ``row`` identifies a row.
    """
    scratch = Scratch(df.sparkSession)
    has = df.where(F.col(vector).isNotNull()).select(F.col(row).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    cells = Cells(has, scratch, block)
    rows = cells.rows
    kind = dict(rows.dtypes)["id"]

    def near(a: SimpleNamespace, b: SimpleNamespace, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, m in within_eps(a.v[asking], b.v, eps):
            yield asking[at : at + len(m)], m

    def count(n: np.ndarray, a: SimpleNamespace, b: SimpleNamespace, asking: np.ndarray) -> None:
        for q, m in near(a, b, asking):
            n[q] += m.sum(1)

    def link(forest: Forest, a: SimpleNamespace, b: SimpleNamespace, asking: np.ndarray) -> None:
        for q, m in near(a, b, asking):
            for i, line in zip(q, m, strict=True):
                for g in np.unique(b.part[line]):
                    forest.join(a.part[i], g)

    def touch(least_of: np.ndarray, a: SimpleNamespace, b: SimpleNamespace, asking: np.ndarray) -> None:
        order = np.argsort(b.cluster, kind="stable")
        b = SimpleNamespace(v=b.v[order], cluster=b.cluster[order])
        for q, m in near(a, b, asking):
            for i, line in zip(q[m.any(1)], m[m.any(1)], strict=True):
                c = b.cluster[line.argmax()]
                least_of[i] = c if least_of[i] is None else min(c, least_of[i])

    def touched(least_of: np.ndarray, a: SimpleNamespace) -> tuple:
        has = np.array([c is not None for c in least_of], bool)
        return a.id[has], least_of[has].tolist()

    def parts(b: pd.DataFrame) -> pd.DataFrame:
        """The core points of a block with the least id that is reached within the block."""
        b = b.sort_values("id")
        part, v = np.arange(len(b)), np.stack(b.v.to_numpy())
        for at, m in within_eps(v, v, eps):
            for line in m:
                met = np.unique(part[line])
                if len(met) > 1:
                    part[np.isin(part, met)] = met[0]
        return b.assign(part=b.id.to_numpy()[part])

    def meet(left: DataFrame, right: DataFrame, *f: Callable | str) -> DataFrame:
        return cells.meet(left, right, F.lit(float(eps)), *f)

    counted = meet(rows, rows, lambda a: np.zeros(len(a.id), np.int64), count, lambda n, a: (a.id, n), f"id {kind}, n bigint")
    core_ids = scratch.write(counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("id"))
    core = scratch.write(rows.join(core_ids, "id", "left_semi").groupBy("blk").applyInPandas(parts, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, part {kind}"))
    # What a block connects is one node, so that dense points make few links between blocks.
    joined = meet(core, core, lambda a: Forest(), link, lambda forest, a: forest.links(), f"a {kind}, b {kind}")
    joined = linked(joined.union(core.select("id", "part")), scratch)
    named = core_ids.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    named = scratch.write(named)
    edge = meet(rows.join(core_ids, "id", "left_anti"), core.drop("part").join(named, "id"), lambda a: np.full(len(a.id), None), touch, touched, f"id {kind}, cluster {kind}").groupBy("id").agg(F.min("cluster").alias("cluster"))
    every = df.select(F.col(row).alias("id")).join(named.union(edge), "id", "left")
    out = scratch.write(every.select(F.col("id").alias(row), F.coalesce("cluster", F.lit(-1)).alias("cluster")))
    scratch.clear(but=out)
    return out


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42, spread: Column | None = None) -> DataFrame:
    """(group, fold): whole groups dealt so that label shares stay even.

    Groups are ordered by size (equal ones by ``spread``, else a seeded hash) and dealt to and fro over
    the folds, by rank in Spark; nothing is collected. Rows without a group are in no fold.
    """
    mixed = F.xxhash64(F.lit(seed), F.col(group)) if spread is None else spread
    n = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.max_by(label, label).alias("_l"))
    r = ranked(n, ["_l"], [-F.col("_n"), mixed, F.col(group)])
    place = F.col("rank") - 1
    turn, pos = F.floor(place / k) % 2, place % k
    return r.select(group, F.when(turn == 0, pos).otherwise(k - 1 - pos).cast("int").alias("fold"))


def _dealt(vectors: list[tuple[np.ndarray, int]], k: int) -> list[tuple[list[int], list[int]]]:
    """For each count vector and its number of groups, in order: the folds of its first groups, and the cycle of folds of the rest.

    Each group goes to the fold that leaves the least mean spread of the folds' label shares, of equal ones the fold with the
    fewest rows. Adding alike to all folds changes no spread, so a state met before, but for that, starts a cycle.
    """
    total = np.maximum(sum((v * n for v, n in vectors), np.zeros_like(vectors[0][0])), 1).astype(float)
    folds, out = np.zeros((k, len(total)), dtype=np.int64), []
    for v, n in vectors:
        chosen, met = [], {}
        while len(chosen) < n:
            state = (folds - folds.min(0)).tobytes()
            if state in met:
                break
            met[state] = len(chosen)
            spread = np.empty(k)
            for f in range(k):
                folds[f] += v
                spread[f] = (folds / total).std(0).mean()
                folds[f] -= v
            best = np.flatnonzero(np.isclose(spread, spread.min(), rtol=1e-9, atol=1e-15))
            f = int(best[folds[best].sum(1).argmin()])
            folds[f] += v
            chosen.append(f)
        at = met[state] if len(chosen) < n else len(chosen)
        cycle = chosen[at:]
        for f in range(k):  # the groups of the cycle that were not dealt one by one
            rest = (n - len(chosen)) // len(cycle) * cycle.count(f) + cycle[: (n - len(chosen)) % len(cycle)].count(f) if cycle else 0
            folds[f] += v * rest
        out.append((chosen[:at], cycle))
    return out


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """(group, fold): whole groups dealt greedily so that each label's rows are spread evenly over k folds.

    Groups come in order of the spread of their label counts, the largest first; each goes to the fold that keeps the
    spread of label shares least. Groups with equal counts are alike, so the driver deals distinct count vectors with
    their number of groups (at most ``most`` vectors, else an error), one by one until a cycle is met; which group of
    equal ones takes which place goes by a seeded hash, ranked in Spark. Rows without group or label are in no fold.
    """
    d = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    labels = sorted(r[0] for r in d.select(label).distinct().collect())  # labels are few
    if not labels:
        return d.select(group, F.lit(0).alias("fold"))
    counts = d.groupBy(group).agg(F.array(*[F.count(F.when(F.col(label) == v, 1)) for v in labels]).alias("_v"))
    found = counts.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different count vectors of groups")
    order = sorted(((np.array(r._v, dtype=np.int64), r.n) for r in found), key=lambda x: (-x[0].std(), tuple(-x[0])))
    plan = [([int(x) for x in v], first, cycle) for (v, _), (first, cycle) in zip(order, _dealt(order, k), strict=True)]
    plans = df.sparkSession.createDataFrame(plan, "_v array<bigint>, _first array<int>, _cycle array<int>")
    r = ranked(counts, ["_v"], [F.xxhash64(F.lit(seed), F.col(group)), F.col(group)]).join(plans, "_v")
    place, early = F.col("rank") - 1, F.size("_first")
    later = F.get("_cycle", ((place - early) % F.when(F.size("_cycle") > 0, F.size("_cycle"))).cast("int"))
    return r.select(group, F.when(place < early, F.get("_first", place.cast("int"))).otherwise(later).alias("fold"))


def cluster_sweep(df: DataFrame, vector: str, ks: range, seed: int = 42) -> DataFrame:
    """(k, cost, sizes): for each k the sum of squared distances to the centres and the clusters' sizes, the largest first."""
    d = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v")).cache()
    rows = []
    for k in ks:
        s = KMeans(k=k, seed=seed, featuresCol="_v").fit(d).summary
        rows.append((k, float(s.trainingCost), sorted((int(n) for n in s.clusterSizes), reverse=True)))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double, sizes array<bigint>")


def clusters_of_inliers(df: DataFrame, vector: str, outlier: str, k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Every row with its cluster among the rows that are no outliers; outliers, and rows where that is unknown, have -1."""
    whole = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    inside = ~F.coalesce(F.col(outlier), F.lit(True))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(whole.where(inside))
    return model.transform(whole).withColumn(name, F.when(inside, F.col("_c")).otherwise(F.lit(-1))).drop("_v", "_c")


def forest(df: DataFrame, vector: str, label: str, trees: int = 50, seed: int = 42, name: str = "prob") -> DataFrame:
    """Random forest with balanced class weights, rows / (classes * rows of the class); adds the positive class's probability."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    all_ = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))  # one row; classes are few
    weights = per.crossJoin(F.broadcast(all_)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_w"))
    d = df.join(F.broadcast(weights), label, "left").withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    fit = RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_w", numTrees=trees, seed=seed, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(d.where(F.col(label).isNotNull()))
    return fit.transform(d).withColumn(name, F.get(vector_to_array("_p"), F.lit(1))).drop("_v", "_p", "_r", "_y", "_w")


def balanced_split(df: DataFrame, row: str, label: str, ratio: int = 10, train: float = 0.75, seed: int = 42) -> DataFrame:
    """(row, label, weight, train): all positives and at most ``ratio`` times as many negatives, split alike in both classes.

    The chosen negatives and the split go by a seeded hash of the row id, ranked over ranges so that no
    task takes a whole class. A row's weight is its class's share of the original rows over its share of
    the kept ones, so that weighted sums have the original prevalence.
    """
    r = ranked(df.where(F.col(label).isin(0, 1)).select(row, label), [label], [F.xxhash64(F.lit(seed), F.col(row)), F.col(row)])
    n = r.groupBy(label).agg(F.max("total").alias("_n"))
    sides = n.agg(F.coalesce(F.max(F.when(F.col(label) == 1, F.col("_n"))), F.lit(0)).alias("_pos"), F.coalesce(F.max(F.when(F.col(label) == 0, F.col("_n"))), F.lit(0)).alias("_neg"))  # one row
    kept_neg = F.least(F.col("_neg"), ratio * F.col("_pos"))
    d = r.crossJoin(F.broadcast(sides)).withColumn("_kept", F.when(F.col(label) == 1, F.col("_pos")).otherwise(kept_neg)).where("rank <= _kept")
    share = (F.col("total") / (F.col("_pos") + F.col("_neg"))) / (F.col("_kept") / (F.col("_pos") + kept_neg))
    return d.select(row, label, share.alias("weight"), (F.col("rank") <= F.ceil(train * F.col("_kept"))).alias("train"))
