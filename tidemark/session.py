"""A session over one dataset: what the service's routes do, as methods that give DataFrames.

State is explicit: tables of rows, the parts of a mixture (a few sums each), models, and a cursor along the batches.
Two sessions share nothing. Rows are (t, attributes.., label, v, f): v all attributes, f the features of models.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DataConfig
from .functions.gaussian import Gaussians
from .operators import drift as D
from .operators import ensemble as E
from .operators import incremental as I
from .operators import kernel as K
from .operators import layout as L
from .operators import mixture as M
from .operators import models as C
from .operators import ordered as O
from .operators import prepare as P
from .sources.kept import drop, keep
from .sources.snapshots import Snapshots

#: Rows of one-row mini-batches that are taken in order on the driver at a time.
IN_ORDER = 10_000
#: The step of a user's move of a component, and the share and number of rows below which a component goes then.
STEP, LEAST_SHARE, LEAST_ROWS = 3.0, 0.01, 10


class Session:
    def __init__(self, spark: SparkSession, rows: DataFrame, config: DataConfig, start: tuple[Snapshots, str] | None = None):
        """Open a dataset of t, the config's attributes and its label; rows beyond skip, cap and stride go.

        ``start``: a snapshot of an earlier session over it, from which this one goes on instead of fitting a mixture.
        """
        self.spark, self.config = spark, config
        kept = P.skip_stride(rows, config.skip, config.stride, config.cap)
        names = list(config.attributes)
        for name in names:
            kept = O.forward_fill(kept, name, "_filled").drop(name).withColumnRenamed("_filled", name)
        kept = kept.select("t", *[(F.col(c).cast("double") * config.mul).alias(c) for c in names], F.col(config.label).cast("string").alias("label"))
        if config.z_scores:
            kept = P.z_scores(kept, names)
        self.attributes = [config.names.get(c, c) for c in names]
        kept = kept.withColumnsRenamed(dict(zip(names, self.attributes, strict=True)))
        features = list(self.attributes)
        for name in self.attributes if config.lags else ():
            kept = O.lags(kept, name, list(range(1, config.lags + 1)))
            features += [f"{name}_{k}" for k in range(1, config.lags + 1)]
        # A row before the first has the values of the first.
        f = F.array(*[F.coalesce(F.col(f"`{c}`"), F.col(f"`{c.rsplit('_', 1)[0]}`")) if c not in self.attributes else F.col(f"`{c}`") for c in features])
        self.all = keep(kept.select("t", *[F.col(f"`{c}`") for c in self.attributes], "label", F.array(*[F.col(f"`{c}`") for c in self.attributes]).alias("v"), f.alias("f")), "session")
        self.n = self.all.count()
        self.minis = config.mini_bounds(self.n)
        self.at = 0
        self.arrived = self.minis[0][-1][1]
        self.models: dict[int, dict] = {}
        self.used: set[int] = set()
        #: The models in use before the last adaptation, and since.
        self.stored: list[list[int] | None] = [None, None]
        self.window = config.window
        self.forced: DataFrame | None = None
        #: The last layout, those since the trace was read, and all by the rows that had arrived then and before.
        self.placed: DataFrame | None = None
        self.trace: list[DataFrame] = []
        self.layouts: dict[tuple[int, int], DataFrame] = {}
        if start is not None:
            self.load(*start)
            return
        parts, placed = M.built(self.rows.select("t", "v"))
        self._set_mixture(parts, placed.where("uncertain").select("t"))

    def close(self) -> None:
        """Delete the session's copy of its rows."""
        drop(self.all)

    @property
    def rows(self) -> DataFrame:
        """Rows that have arrived."""
        return self.all.where(F.col("t") < self.arrived)

    @property
    def bounds(self) -> list[tuple[int, int]]:
        return [(minis[0][0], minis[-1][1]) for minis in self.minis]

    def timestamps(self, start: str = "2000-01-01 00:00:00") -> DataFrame:
        """(t, ts): hourly, for a dataset without times."""
        return self.rows.select("t", P.hourly(F.col("t"), start).alias("ts"))

    # Mixture

    @property
    def components(self) -> DataFrame:
        """(label, n, mu, s, log_det, log_weight) of the mixture's parts."""
        return M.frame(self.all, self._gaussians(), self.arrived)

    def _gaussians(self) -> Gaussians:
        keys = sorted(self.parts)
        of = [self.parts[k] for k in keys]
        return Gaussians(keys, np.array([c.mu for c in of]), np.array([c.s for c in of]), np.log([c.share for c in of]))

    def _set_mixture(self, parts: Gaussians, uncertain: DataFrame, keys: Sequence[int] | None = None) -> None:
        keys, n = list(parts.keys if keys is None else keys), self.arrived
        self.parts = {k: I.Part.of(mu, s, float(np.exp(w)) * n, n) for k, mu, s, w in zip(keys, parts.mu, parts.s, parts.log_weight, strict=True)}
        self._set_uncertain(uncertain)
        self._set_limits()

    def _set_uncertain(self, rows: DataFrame) -> None:
        self.uncertain = keep(rows.select("t"), "uncertain")
        self.n_uncertain = self.uncertain.count()

    def _set_limits(self) -> None:
        """Thresholds of each part from the scores of its own certain rows; a part without any has hardly any room."""
        placed = M.assign(self.rows.select("t", "v").join(self.uncertain, "t", "left_anti"), self.components)
        found = {r["component"]: (r["relax"], r["strict"]) for r in M.thresholds(placed, many=len(self.parts) > 5).collect()}
        self.limits = {k: found.get(k, (1e-5, 1e-5)) for k in self.parts}

    def advance(self) -> bool:
        """The next batch arrives, a mini-batch at a time; whether there was one. The last batch ends with the data."""
        if self.at + 1 >= len(self.minis):
            return False
        self.at += 1
        minis = self.minis[self.at]
        k = 0
        while k < len(minis):
            a, b = minis[k]
            k += 1
            if b - a > 1:
                self._take(a, b)
                continue
            while k < len(minis) and minis[k][1] - minis[k][0] == 1 and k < len(minis) and b - a < IN_ORDER:
                b, k = minis[k][1], k + 1
            self._take_in_order(a, b)
        return True

    def _take(self, a: int, b: int) -> None:
        """A mini-batch: its rows are scored by the parts as they were before it, and added to them together."""
        g, limits = self._gaussians(), self.limits
        relax, strict = (np.array([limits[k][i] for k in g.keys]) for i in (0, 1))
        new = self.all.where((F.col("t") >= a) & (F.col("t") < b)).select("t", "v")

        def run(batches):
            weight, first, second = np.zeros(len(g.keys)), np.zeros_like(g.mu), np.zeros_like(g.s)
            for batch in batches:
                x = M.matrix(batch)
                scores = g.score(x, True)
                best = scores.argmin(axis=1)
                near = x[scores[np.arange(len(x)), best] < strict[best]]
                p = g.posterior(near)
                weight, first, second = weight + p.sum(axis=0), first + p.T @ near, second + np.einsum("nk,ni,nj->kij", p, near, near)
            rows = [[float(weight[k]), *first[k].tolist(), *second[k].ravel().tolist()] for k in range(len(g.keys))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["k", "sums"])

        d = g.mu.shape[1]
        limit = self.spark.createDataFrame([(k, float(r)) for k, r in zip(g.keys, relax, strict=True)], "component int, _limit double")
        far = keep(M.assign(new, self.components).join(limit, "component").where("score >= _limit").select("t"), "far")
        self.arrived = b
        added = new.mapInArrow(run, "k int, sums array<double>").select("k", F.posexplode("sums").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros((len(g.keys), 1 + d + d * d))
        for r in added:
            sums[r["k"], r["i"]] = r["x"]
        for i, k in enumerate(g.keys):
            old = self.parts[k]
            self.parts[k] = I.Part(float(old.weight + sums[i, 0]), old.first + sums[i, 1 : 1 + d], old.second + sums[i, 1 + d :].reshape(d, d), b)
        if not far.isEmpty():
            self._set_uncertain(self.uncertain.union(far))
            self._grow()

    def _take_in_order(self, a: int, b: int) -> None:
        """Mini-batches of one row: each is scored by the parts that the ones before it changed, so they come one after another."""
        new: list[tuple[int]] = []
        for row in self.all.where((F.col("t") >= a) & (F.col("t") < b)).select("t", "v").orderBy("t").collect():
            x, g = np.array([row["v"]]), self._gaussians()
            self.arrived = row["t"] + 1
            scores = g.score(x, True)[0]
            k = int(scores.argmin())
            relax, strict = self.limits[g.keys[k]]
            if scores[k] < strict:
                for key, p in zip(g.keys, g.posterior(x)[0], strict=True):
                    self.parts[key] = I.updated(self.parts[key], x[0], float(p))
            if scores[k] >= relax:
                new.append((row["t"],))
                if self.n_uncertain + len(new) > max(self.config.gmm_threshold, self.arrived // 12):
                    self._set_uncertain(self.uncertain.union(self.spark.createDataFrame(new, "t long")))
                    new = []
                    self._grow()
        if new:
            self._set_uncertain(self.uncertain.union(self.spark.createDataFrame(new, "t long")))

    def _grow(self) -> None:
        """Where too many rows are uncertain, they get parts of their own, and all rows are fitted anew from all parts."""
        n, u = self.arrived, self.n_uncertain
        if u <= max(self.config.gmm_threshold, n // 12):
            return
        points = self.rows.select("t", "v")
        new, _ = M.built(points.join(self.uncertain, "t", "left_semi"), min(7, 1 + round(u / 50)))
        if not new.keys:
            return
        old = self._gaussians()
        after = max(old.keys) + 1
        keys = [*old.keys, *(after + k for k in new.keys)]
        both = Gaussians(keys, np.concatenate([old.mu, new.mu]), np.concatenate([old.s, new.s]), np.concatenate([old.log_weight + np.log(max(n - u, 1)), new.log_weight + np.log(u)]))
        both.log_weight = both.log_weight - np.log(np.exp(both.log_weight).sum())
        if len(keys) < 5:
            placed = M.assign(points, M.frame(points, both, n), weighted=False).persist()
            limit = placed.groupBy("component").agg(F.percentile("score", F.lit(0.99)).alias("_limit"))
            far = placed.join(limit, "component").where("score > _limit").select("t")
            counts = {r["component"]: r["count"] for r in placed.groupBy("component").count().collect()}
            total = max(n - far.count(), 1)
            both.log_weight = np.log([max(counts.get(k, 0), 1e-9) / total for k in keys])
            self._set_mixture(both, far)
            placed.unpersist()
        else:
            start = Gaussians(keys, both.mu, both.s, both.log_weight)
            left, placed = M.built(points, start=start, n_keep=len(old.keys) + 4)
            self._set_mixture(left, placed.where("uncertain").select("t"))

    def chunks(self) -> DataFrame:
        """(chunk_id, t): batches from 1 on."""
        when = F.lit(None).cast("int")
        for k, (a, b) in enumerate(self.bounds[: self.at + 1], 1):
            when = F.when((F.col("t") >= a) & (F.col("t") < b), k).otherwise(when)
        return self.rows.select(when.alias("chunk_id"), "t")

    def labels(self, mixture: bool = True) -> DataFrame:
        """(t, label): components of the mixture (those that a user set come first), or classes."""
        if not mixture:
            return self.rows.select("t", "label")
        found = M.assign(self.rows.select("t", "v"), self.components).select("t", F.col("component").alias("label"))
        if self.forced is None:
            return found
        return found.join(self.forced.withColumnRenamed("label", "_set"), "t", "left").select("t", F.coalesce("_set", "label").alias("label"))

    def component_idx(self) -> DataFrame:
        return self.labels().groupBy("label").agg(F.array_sort(F.collect_list("t")).alias("idx"))

    def _moved(self, key: int, rows: DataFrame, step: float) -> None:
        """A part's mean moved by rows (order, v) one after another: each takes ``step`` of the part's weight."""
        self.parts |= I.moved({key: self.parts[key]}, rows, lambda x: np.full((len(x), 1), step))

    def merge_component(self, idx: DataFrame) -> int:
        """The selected rows become those of the component that most of them are of; returns it.

        Its mean moves towards the others of them, theirs away. Components that are then small go, all rows are assigned anew,
        and the selection stays where it was put.
        """
        idx = idx.select("t").distinct()
        open_ = F.col("_open").isNotNull()
        marked = self.uncertain.withColumn("_open", F.lit(1))
        chosen = self.labels().join(idx, "t", "left_semi").join(self.rows.select("t", "v"), "t").join(marked, "t", "left").persist()
        counts = chosen.groupBy("label").count().orderBy(F.desc("count"), "label").first()
        if counts is None:
            raise ValueError("no rows are selected")
        major = int(counts["label"])
        self._moved(major, chosen.where(open_ | (F.col("label") != major)).select(F.col("t").alias("order"), "v"), STEP)
        for r in chosen.where(~open_ & (F.col("label") != major)).select("label").distinct().collect():
            self._moved(int(r["label"]), chosen.where(~open_ & (F.col("label") == r["label"])).select(F.col("t").alias("order"), "v"), -STEP)
        self._set_uncertain(self.uncertain.join(chosen.select("t"), "t", "left_anti"))
        chosen.unpersist()
        self.forced = keep(P.set_labels(self.forced, idx, major), "forced")
        sizes = {r["label"]: r["count"] for r in self.labels().groupBy("label").count().collect()}
        total = sum(sizes.values())
        for key in sorted(self.parts):
            if (sizes.get(key, 0) < LEAST_ROWS or sizes.get(key, 0) / total < LEAST_SHARE) and key != major and len(self.parts) > 1:
                self.delete_component(key)
        self._set_limits()
        return major

    def delete_component(self, key: int) -> None:
        """A part goes; its rows move the others by their posteriors, and are assigned to the nearest ones from then on."""
        own = keep(self.labels().where(F.col("label") == key).join(self.rows.select("t", "v"), "t").select(F.col("t").alias("order"), "v"), "deleted")
        del self.parts[key]
        g = self._gaussians()  # its keys are in the order of the parts
        self.parts = I.moved(self.parts, own, g.posterior)
        drop(own)
        if self.forced is not None:
            self.forced = self.forced.where(F.col("label") != key)

    def regroup(self, idx: DataFrame, most: float = 0.6) -> int:
        """The selected rows as a component of their own, in place of those that they hold over ``most`` of; all rows are fitted anew from there."""
        idx = idx.select("t").distinct()
        counts = self.labels().join(idx.withColumn("_in", F.lit(1)), "t", "left").groupBy("label").agg(F.count("_in").alias("inside"), F.count(F.lit(1)).alias("n")).collect()
        gone = [r["label"] for r in counts if r["inside"] > most * r["n"]]
        inside, total = sum(r["inside"] for r in counts), sum(r["n"] for r in counts)
        g = self._gaussians()
        stay = [i for i, k in enumerate(g.keys) if k not in gone]
        key = min(gone) if gone else max(g.keys) + 1
        own = M.moments(P.select_idx(self.rows, idx).select(F.lit(0).alias("label"), "v")).first()
        d = g.mu.shape[1]
        s = np.reshape(own["s"], (d, d)) + 1e-6 * np.eye(d)
        weights = np.append(np.exp(g.log_weight[stay]), inside / total)
        start = Gaussians([*(g.keys[i] for i in stay), key], np.vstack([g.mu[stay], [own["mu"]]]), np.concatenate([g.s[stay], [s]]), np.log(weights / weights.sum()))
        left, placed = M.built(self.rows.select("t", "v"), start=start)
        self._set_mixture(left, placed.where("uncertain").select("t"))
        return key

    def adjust_component(self, idx: DataFrame, most: float = 0.8) -> dict[int, int]:
        """New components for the selected rows and all rows of the components that they hold over ``most`` of, which go; then all rows are fitted anew from the others and these.

        A new component takes the label of the one among those that went with which it shares most rows (pairs of most rows first), or a
        label of its own; returns the labels taken over, by the new fit's numbers.
        """
        idx = idx.select("t").distinct()
        marked = keep(self.labels().join(idx.withColumn("_in", F.lit(1)), "t", "left"), "marked")
        counts = marked.groupBy("label").agg(F.count("_in").alias("inside"), F.count(F.lit(1)).alias("n")).collect()
        gone = [r["label"] for r in counts if r["inside"] > most * r["n"]]
        chosen = marked.where(F.col("_in").isNotNull() | F.col("label").isin(gone))
        points = self.rows.select("t", "v")
        new, placed = M.built(points.join(chosen.select("t"), "t", "left_semi"))
        if not new.keys:
            return {}
        shared = placed.select("t", "component").join(chosen.where(F.col("label").isin(gone)).select("t", "label"), "t")
        found = {r["new"]: r["old"] for r in M.matched(shared.groupBy(F.col("label").alias("old"), F.col("component").alias("new")).agg(F.count(F.lit(1)).alias("n"))).collect()}
        old, m, n = self._gaussians(), chosen.count(), self.arrived
        stay = [i for i, k in enumerate(old.keys) if k not in gone]
        fresh = iter(range(max(old.keys) + 1, max(old.keys) + 1 + len(new.keys)))
        keys = [*(old.keys[i] for i in stay), *(found[k] if k in found else next(fresh) for k in new.keys)]
        weights = np.concatenate([np.exp(old.log_weight[stay]) * max(n - m, 1), np.exp(new.log_weight) * m])
        start = Gaussians(keys, np.concatenate([old.mu[stay], new.mu]), np.concatenate([old.s[stay], new.s]), np.log(weights / weights.sum()))
        left, placed = M.built(points, start=start)
        self._set_mixture(left, placed.where("uncertain").select("t"))
        return found

    # Models

    def _train(self) -> Column:
        return C.fold_flags(F.col("t"), self.config.folds, self.config.train_rate)

    def add_model(self, idx: DataFrame) -> int:
        """Train a model of every fold on the selected rows; the same selection is the same model."""
        own = self.all.join(idx.select("t").distinct(), "t", "left_semi").persist()
        stats = own.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("t")).alias("h")).first()
        if not stats["n"]:
            raise ValueError("a model needs rows")
        number = (stats["h"] ^ stats["n"]) % 100_000_007
        if number not in self.models:
            classes = sorted(r["label"] for r in self.all.select("label").distinct().collect())
            ready = own.select("t", "f", "label", self._train().alias("train"))
            radial = self.config.model == "radial"
            make, how = (K.fit, {"gamma": self.config.gamma}) if radial else (C.fit, {})
            made = C.fit_by_validation(ready, classes, make, balanced=self.config.balanced, **how) if self.config.by_validation else make(ready, classes, balanced=self.config.balanced, **how)
            moments = M.moments(own.select(F.lit(0).alias("label"), F.col("f").alias("v"))).first()
            self.models[number] = {"idx": idx.select("t"), "model": made, "moments": moments, "n": stats["n"]}
            self.used.add(number)
        own.unpersist()
        return number

    def set_active(self, use: Mapping[int, bool]) -> None:
        for number, on in use.items():
            if number not in self.models:
                raise KeyError(number)
            (self.used.add if on else self.used.discard)(number)

    def use_only(self, numbers: Sequence[int]) -> None:
        self.set_active({k: k in numbers for k in self.models})

    def adapt(self) -> bool:
        """From now on compare with the models in use now; whether they changed. Drift scores are always of the models in use."""
        now = sorted(self.used)
        if not now or now == self.stored[1]:
            return False
        self.stored = [self.stored[1], now]
        return True

    def trained_idx(self, of: Sequence[int] | None = None) -> DataFrame:
        """Rows that any used model was trained on, once each."""
        sets = [self.models[m]["idx"] for m in (sorted(self.used) if of is None else of)]
        if not sets:
            return self.all.select("t").limit(0)
        found = sets[0]
        for more in sets[1:]:
            found = found.union(more)
        return found.distinct()

    def model_table(self) -> DataFrame:
        made = [(k, k in self.used, m["n"]) for k, m in sorted(self.models.items())]
        return self.spark.createDataFrame(made, "model_id long, use boolean, n long")

    def _model_frame(self, of: Sequence[int]) -> DataFrame:
        made = [(k, [*map(float, self.models[k]["moments"]["mu"])], [*map(float, self.models[k]["moments"]["s"])]) for k in of]
        return self.spark.createDataFrame(made, "model_id long, mu array<double>, s array<double>")

    def _distances(self, rows: DataFrame, of: Sequence[int]) -> DataFrame:
        return E.distances(rows.select("t", F.col("f").alias("v")), self._model_frame(of))

    def _predictions(self, rows: DataFrame, of: Sequence[int], fold: int | None, outside: str | None = None) -> DataFrame:
        parts = None
        for k in of:
            one = C.predict(rows, self.models[k]["model"], fold, outside).withColumn("model_id", F.lit(k).cast("long"))
            parts = one if parts is None else parts.union(one)
        return parts

    def predict(self, rows: DataFrame | None = None) -> DataFrame:
        """(t, class, proba): used models' predictions of the first fold, pooled by how near each is to the row."""
        rows, of = self.rows if rows is None else rows, sorted(self.used)
        return E.pool(self._predictions(rows, of, 0), self._distances(rows, of))

    def _judged(self, rows: DataFrame | None = None) -> DataFrame:
        return E.best_class(self.predict(rows)).join(self.all.select("t", F.col("label").alias("truth")), "t")

    def evaluate(self, idx: DataFrame | None = None, of: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """By folds: (fold, acc) on the rows each left out, the median fold's row, and its squares (class, bin, kind, other, n, idx).

        ``idx``: the rows, by default the latest batch or ``test_size`` of them if it is smaller.
        """
        of = sorted(self.used) if of is None else list(of)
        a, b = self.bounds[self.at]
        rows = P.last_rows(self.rows, max(self.config.test_size, b - a)) if idx is None else P.select_idx(self.rows, idx.select("t").distinct())
        ready = rows.select("t", "f", self._train().alias("train"))
        pooled = E.pool(self._predictions(ready, of, None, "train"), self._distances(ready, of), ("t", "fold"))
        judged = E.best_class(pooled, ("t", "fold")).join(rows.select("t", F.col("label").alias("truth")), "t").persist()
        accuracies = judged.groupBy("fold").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))
        median = E.median_fold(accuracies)
        return accuracies, median, E.squares(judged.join(F.broadcast(median.select("fold")), "fold").select("t", "truth", "pred", "score"))

    def squares(self, idx: DataFrame | None = None) -> DataFrame:
        """Right and wrong predictions by class and confidence."""
        rows = self.rows if idx is None else P.select_idx(self.rows, idx.select("t").distinct())
        return E.squares(self._judged(rows))

    def compared_squares(self, idx: DataFrame | None = None) -> DataFrame:
        """(which, acc, ..squares) of the median folds of the models before the last adaptation (previous) and since (current)."""
        found = None
        for which, of in zip(("previous", "current"), self.stored, strict=True):
            if of:
                _, median, squares = self.evaluate(idx, of)
                one = squares.join(F.broadcast(median.select("acc"))).select(F.lit(which).alias("which"), "acc", *squares.columns)
                found = one if found is None else found.union(one)
        if found is None:
            raise ValueError("no models were adapted yet")
        return found

    def accuracy(self, last: Sequence[int] = (30, 45, 60, 90)) -> DataFrame:
        """(last, acc): over the latest rows."""
        judged = self._judged(P.last_rows(self.rows, max(last)))
        wide = P.with_stats(judged, F.max("t").alias("_end")).withColumn("last", F.explode(F.array(*map(F.lit, last))))
        return wide.where(F.col("t") > F.col("_end") - F.col("last")).groupBy("last").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))

    # Drift

    def drift(self, sliding: bool | None = None) -> DataFrame:
        """(t or chunk_id, attribute, drift): of each attribute, and under ED the worst of these and of all attributes together."""
        sliding = not self.config.drift_of_batches if sliding is None else sliding
        key, found = ("t" if sliding else "chunk_id"), None
        labels, trained_idx, chunks = self.labels().persist(), self.trained_idx().persist(), self.chunks()
        for name in (*self.attributes, None):
            value = F.col("v") if name is None else F.col(f"`{name}`").alias("x")
            rows = self.rows.select("t", value).join(labels, "t")
            trained = rows.join(trained_idx, "t", "left_semi")
            one = D.sliding(rows, trained, self.window, self.config.neighbours) if sliding else D.of_chunks(rows.join(chunks, "t"), trained, self.config.neighbours)
            one = one.withColumn("attribute", F.lit(name or "all"))
            found = one if found is None else found.union(one)
        found = keep(found, "drift")
        labels.unpersist()
        trained_idx.unpersist()
        worst = found.groupBy(key).agg(F.max("drift").alias("drift")).withColumn("attribute", F.lit("ED"))
        return found.unionByName(worst).select(key, "attribute", "drift")

    def origin_series(self, attribute: str) -> DataFrame:
        scaled = P.min_max(self.rows.select("t", F.col(f"`{attribute}`").alias("y")), "y", "x")
        return O.moving_average(scaled, "x", "origin", self.config.arm, self.config.arm).select("t", "origin")

    def series(self, attributes: Sequence[str], origin: bool = False) -> DataFrame:
        """(t, key, value): the asked attributes' drift under <attribute>_ED, or their averages under <attribute>_Origin."""
        if not origin:
            return self.drift(True).where(F.col("attribute").isin(*attributes)).select("t", F.concat("attribute", F.lit("_ED")).alias("key"), F.col("drift").alias("value"))
        found = None
        for name in attributes:
            one = self.origin_series(name).select("t", F.lit(f"{name}_Origin").alias("key"), F.col("origin").alias("value"))
            found = one if found is None else found.union(one)
        return found

    def set_window(self, window: int) -> None:
        self.window = max(self.config.least_window, min(self.config.most_window, window))

    # Views

    def chunk_table(self) -> DataFrame:
        """(chunk_id, n, first, last, drift, latest)."""
        sizes = self.chunks().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
        drift = self.drift(sliding=False).where("attribute = 'ED'").select("chunk_id", "drift") if self.used else sizes.select("chunk_id", F.lit(1.0).alias("drift"))
        return sizes.join(drift, "chunk_id", "left").withColumn("latest", F.col("chunk_id") == self.at + 1)

    def chunk_summary(self, idx: DataFrame) -> DataFrame:
        """(key, share): which components the selected rows are of."""
        sets = self.labels().select(F.col("label").alias("key"), "t")
        return M.shares(idx.select("t"), sets)

    def model_shares(self, idx: DataFrame) -> DataFrame:
        of = sorted(self.used)
        return E.share_by_nearest(self._distances(P.select_idx(self.rows, idx.select("t")), of), self._model_frame(of))

    def basic_stat(self, idx: DataFrame, positive: str) -> DataFrame:
        chosen = P.select_idx(self.rows, idx.select("t"))
        return chosen.agg(F.sum((F.col("label") == positive).cast("long")).alias("y_true"), *[f(F.col(f"`{c}`")).alias(f"{c}_{n}") for c in self.attributes for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])

    def origin(self, idx: DataFrame) -> DataFrame:
        return P.select_idx(self.rows, idx.select("t"))

    def selection(self, idx: DataFrame, positive: str) -> DataFrame:
        """One row of a selection: its number, positives, and each attribute's mean, least and largest."""
        parts = [f(F.col(f"`{c}`")).alias(f"{c}_{n}") for c in self.attributes for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
        return self.origin(idx).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == positive).cast("long")).alias("positive"), *parts)

    def layout(self, attributes: Sequence[str] | None = None) -> DataFrame:
        """(t, x, y): the fitted layout of the rows; with ``attributes``, on the main axes of layout and attributes.

        After the first layout, rows that are new since begin at their nearest old one and move against sampled old rows and
        components' means; older rows than the last 1500 stay. While no rows are new, the layout is the same table.
        """
        before = max((n for n, _ in self.layouts), default=0)
        if before != self.arrived:
            points = self.rows.select("t", "v").join(self.labels(), "t")
            found = L.fitted(points.select("t", "v")) if self.placed is None else L.continued(points, self.placed)
            self.placed = self.layouts[self.arrived, before] = keep(found, "layout")
        self.trace.append(self.placed)
        if not attributes:
            return self.placed
        joined = self.placed.join(self.rows.select("t", *[F.col(f"`{c}`") for c in attributes]), "t")
        return L.main_axes(joined, [*attributes, "x", "y"])

    def layout_trace(self) -> DataFrame:
        """(t, x, y): where each row lay, layout by layout, to four places; reading it clears it."""
        steps, self.trace = self.trace, []
        found = None
        for k, step in enumerate(steps):
            one = step.select("t", F.lit(k).alias("step"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
            found = one if found is None else found.union(one)
        made = found.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("s"))
        return made.select("t", F.col("s.x").alias("x"), F.col("s.y").alias("y"))

    # History

    def save(self, snapshots: Snapshots) -> str:
        parts = [(k, float(c.weight), c.first.tolist(), c.second.ravel().tolist(), float(c.rows), *map(float, self.limits[k])) for k, c in sorted(self.parts.items())]
        tables = {
            "rows": self.all, "parts": self.spark.createDataFrame(parts, "k int, weight double, first array<double>, second array<double>, n double, relax double, strict double"),
            "uncertain": self.uncertain,
            "cursor": self.spark.createDataFrame([(self.at, self.window, self.arrived)], "at int, window int, arrived long"),
        }
        if self.forced is not None:
            tables["forced"] = self.forced
        if self.models:
            idx = None
            for k, m in sorted(self.models.items()):
                one = m["idx"].select(F.lit(k).cast("long").alias("model_id"), F.lit(k in self.used).alias("use"), "t")
                idx = one if idx is None else idx.union(one)
            tables["models"] = idx
            fitted = [(k, k in self.used, type(m["model"]).__name__, C.dumped(m["model"]), json.dumps({x: m["moments"][x] for x in ("label", "n", "mu", "s", "log_det")}), int(m["n"])) for k, m in sorted(self.models.items())]
            tables["fitted"] = self.spark.createDataFrame(fitted, "model_id long, use boolean, kind string, model string, moments string, n long")
        if self.placed is not None:
            tables["placed"] = self.placed.withColumn("arrived", F.lit(max(n for n, _ in self.layouts)))
        return snapshots.save(tables)

    def load(self, snapshots: Snapshots, name: str) -> None:
        """Rows, mixture, cursor, models and the last layout as saved; nothing is fitted."""
        tables = snapshots.load(name)
        drop(self.all)
        self.all = keep(tables["rows"], "session")
        self.parts, self.limits = {}, {}
        for r in tables["parts"].collect():
            d = len(r["first"])
            self.parts[r["k"]] = I.Part(r["weight"], np.array(r["first"]), np.reshape(r["second"], (d, d)), r["n"])
            self.limits[r["k"]] = (r["relax"], r["strict"])
        self._set_uncertain(tables["uncertain"])
        self.at, self.window, self.arrived = tables["cursor"].first()
        self.forced = tables.get("forced")
        self.models, self.used = {}, set()
        for r in tables["fitted"].orderBy("model_id").collect() if "fitted" in tables else ():
            made = C.restored({"Models": C.Models, "Machines": K.Machines}[r["kind"]], r["model"])
            self.models[r["model_id"]] = {"idx": tables["models"].where(F.col("model_id") == r["model_id"]).select("t"), "model": made, "moments": json.loads(r["moments"]), "n": r["n"]}
            self.set_active({r["model_id"]: r["use"]})
        self.layouts, self.placed, self.trace = {}, None, []
        if "placed" in tables:
            self.placed = tables["placed"].select("t", "x", "y")
            self.layouts[tables["placed"].first()["arrived"], 0] = self.placed
