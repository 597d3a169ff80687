"""Models MLlib lacks, built from Spark aggregates and MLlib pieces.

* LDA (E7): class counts, means and the pooled within-class scatter come from one
  grouped aggregate of means and pairwise covariances; the (d x d) solve is on the
  driver; scoring is a JVM projection (one linear discriminant per class).
* AdaBoost / SAMME (E8): depth-1 trees by MLlib's rules. Rows with equal bins and class
  have one weight in every round; where such cells are few (``cells.MOST``) they are
  counted once and the rounds run on the counts. Otherwise MLlib fits on a weight column;
  after each round the weights are updated by a projection and the frame is checkpointed
  every few rounds to the session's checkpoint dir (lineage stays short, executor loss is
  survivable).
  Stumps are read back as (feature, threshold, left, right) so prediction is one
  expression, not a chain of 100 model transforms.
* RBF SVM (E4): random Fourier features (Rahimi & Recht, 2007) approximating the
  Gaussian kernel with gamma = 1 / (d * Var(X)) ("scale"), then MLlib's LinearSVC
  (one-vs-rest for more than two classes) and Platt scaling (logistic regression on
  the margin) for probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import cells, celltrees
from .models import gathered

SEED = 42
#: MLlib's number of bins, chosen anew by the weights of each round
MAX_BINS = 32
#: least and most bins that these are chosen from, of a column of a table of more than ``cells.MOST`` rows
FINE_BINS = 128, 1024


def _x(c):
    return F.col(c).cast("double")


# ---------------------------------------------------------------------------
# LDA
# ---------------------------------------------------------------------------

class LDAModel:
    def __init__(self, classes, coef, intercept, features):
        self.classes, self.coef, self.intercept, self.features = classes, coef, intercept, features

    def scores(self):
        return [sum((F.lit(float(self.coef[k][j])) * _x(f) for j, f in enumerate(self.features)),
                    F.lit(float(self.intercept[k]))) for k in range(len(self.classes))]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        sc = F.array(*self.scores())
        labels = F.array(*[F.lit(c) for c in self.classes])
        # first class with the maximal score
        idx = F.array_position(sc, F.array_max(sc))
        return df.withColumn(out, F.element_at(labels, idx.cast("int")))


def lda_class_stats(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(class, n, prior, mean_<f>...) - the aggregate part of LDA."""
    d = df.select(F.col(label).cast("string").alias("class"), *[_x(f).alias(f) for f in features]).dropna()
    agg = d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features])
    tot = d.count()
    return agg.withColumn("prior", F.col("n") / F.lit(float(tot)))


def lda_fit(df: DataFrame, features: Sequence[str], label: str) -> LDAModel:
    """Linear discriminants with the pooled covariance S_w / (n - K)."""
    features = list(features)
    d = df.select(F.col(label).cast("string").alias("class"), *[_x(f).alias(f) for f in features]).dropna()
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]
    for i in range(len(features)):
        for j in range(i, len(features)):
            aggs.append(F.coalesce(F.covar_samp(features[i], features[j]), F.lit(0.0)).alias(f"c{i}_{j}"))
    rows = sorted(d.groupBy("class").agg(*aggs).collect(), key=lambda r: r["class"])
    p = len(features)
    n = sum(r["n"] for r in rows)
    K = len(rows)
    S = np.zeros((p, p))
    for r in rows:
        for i in range(p):
            for j in range(i, p):
                S[i, j] += r[f"c{i}_{j}"] * (r["n"] - 1)
                S[j, i] = S[i, j]
    sigma = S / max(n - K, 1)
    inv = np.linalg.pinv(sigma)
    coef, icpt = [], []
    for r in rows:
        mu = np.array([r[f"m{i}"] for i in range(p)])
        w = inv @ mu
        coef.append(w)
        icpt.append(-0.5 * mu @ w + math.log(r["n"] / n))
    return LDAModel([r["class"] for r in rows], coef, icpt, features)


# ---------------------------------------------------------------------------
# AdaBoost (SAMME with stumps)
# ---------------------------------------------------------------------------

def _stump_rule(model):
    """(feature_index, threshold, left_prediction, right_prediction) of a depth-1 tree."""
    root = model._java_obj.rootNode()
    if not root.getClass().getSimpleName().startswith("InternalNode"):
        return None, None, root.prediction(), root.prediction()
    split = root.split()
    return (int(split.featureIndex()), float(split.threshold()), float(root.leftChild().prediction()),
            float(root.rightChild().prediction()))


def _leaf_weights(model) -> tuple[float, float]:
    """(weight of all rows, weight of the misclassified ones), as the fit has added them up in the leaves."""
    root = model._java_obj.rootNode()
    inner = root.getClass().getSimpleName().startswith("InternalNode")
    leaves = [root.leftChild(), root.rightChild()] if inner else [root]
    stats = [(list(x.impurityStats().stats()), int(x.prediction())) for x in leaves]
    return sum(sum(w) for w, _ in stats), sum(v for w, p in stats for i, v in enumerate(w) if i != p)


class AdaBoostModel:
    def __init__(self, stumps, alphas, classes, features):
        self.stumps, self.alphas, self.classes, self.features = stumps, alphas, classes, features

    def _stump_expr(self, s):
        fi, thr, left, right = s
        if fi is None:
            return F.lit(left)
        return F.when(_x(self.features[fi]) <= F.lit(thr), F.lit(left)).otherwise(F.lit(right))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scores = []
        for k in range(len(self.classes)):
            terms = [F.when(self._stump_expr(s) == F.lit(float(k)), F.lit(a)).otherwise(F.lit(0.0))
                     for s, a in zip(self.stumps, self.alphas)]
            scores.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
        sc = F.array(*scores)
        labels = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(out, F.element_at(labels, F.array_position(sc, F.array_max(sc)).cast("int")))


class _Rounds:
    """Total weights and misses of a stump, and the weights it leaves, on cells. ``seen`` has the columns of the rows that MLlib
    would choose cuts from, as places of ``values``; without it cuts are chosen from the weights of the fine bins."""

    def __init__(self, found, k: int, edges: list[np.ndarray], values: list[np.ndarray] | None = None, seen: list[np.ndarray] | None = None,
                 share: float = 1.0):
        self.bins, (self.y,), n, _ = found
        self.k, self.edges, self.values, self.seen, self.share = k, edges, values, seen, share
        self.rows = n.astype(float)
        self.w = self.rows / self.rows.sum()

    def _cuts(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(thresholds, bin between them of each bin of the cells) of a column in this round."""
        n_splits = int(min(MAX_BINS, self.rows.sum())) - 1
        if self.values is None:
            at = cells.thresholds(np.bincount(self.bins[:, j], self.w, len(self.edges[j]) + 1), n_splits)
            return self.edges[j][at], np.searchsorted(at, np.arange(len(self.edges[j]) + 1), side="left")
        cell, place = self.seen[-1], self.seen[j]
        weight = np.bincount(place, (self.w / self.rows)[cell], len(self.values[j]))
        on = np.bincount(place, minlength=len(weight)) > 0
        found = cells.cuts(self.values[j][on], weight[on], n_splits, self.share * self.w.sum(), len(cell))
        return found, np.searchsorted(found, self.values[j], side="left")

    def stump(self) -> tuple:
        """(rule as of ``_stump_rule``, weight of all rows, weight of the missed ones); ``miss`` keeps which those are."""
        found = [self._cuts(j) for j in range(len(self.edges))]
        coarse = np.stack([of[self.bins[:, j]] for j, (_, of) in enumerate(found)], 1)
        way: list = []
        tree = celltrees.grow(coarse, self.y, self.w, self.rows, [len(c) + 1 for c, _ in found], self.k, 1, way=way)
        answer = tree.predictions()
        tree.pruned()
        if tree.left[0] < 0:
            rule, said = (None, None, float(answer[0]), float(answer[0])), np.full(len(self.y), answer[0])
        else:
            j, at = tree.feature[0], tree.left[0]
            rule = (j, float(found[j][0][tree.cut[0]]), float(answer[at]), float(answer[at + 1]))
            said = answer[way[0]]
        self.miss = said != self.y
        return rule, float(self.w.sum()), float(self.w[self.miss].sum())

    def reweight(self, alpha: float, total: float) -> None:
        self.w = self.w * np.exp(alpha * self.miss) / total


def _rounds(rows: DataFrame, features: list[str], k: int) -> _Rounds | None:
    """Cells of rows (features, label), or None where they are too many. Where rows are no more than cells may be, a
    cell is a combination of values and the cuts are those MLlib chooses; else a column has fine bins."""
    n, _, whole, binary = cells.look(rows, features, "label")
    if not whole or not n:
        return None
    if n <= cells.MOST:
        rows = gathered(rows)
        values = [np.unique(x) for x in cells.sampled(rows.select(*features), 1.0, SEED)]
        edges = [(v[:-1] + v[1:]) / 2 for v in values]
        found = cells.counted(rows, features, edges, [("label", k)])
        if found is None:
            return None
        share = cells.fraction(n, MAX_BINS)
        *seen, y = cells.sampled(rows.select(*features, "label"), share, SEED)
        seen = [np.searchsorted(v, x) for v, x in zip(values, seen, strict=True)]
        cell = {at: i for i, at in enumerate(zip(*found[0].T.tolist(), found[1][0].tolist(), strict=True))}
        seen.append(np.array([cell[at] for at in zip(*(x.tolist() for x in seen), y.astype(int).tolist(), strict=True)], int))
        return _Rounds(found, k, edges, values, seen, share)
    least, most = FINE_BINS
    wide = max(1, len(features) - sum(binary))
    fine = int(min(max((cells.MOST / k / 2 ** sum(binary)) ** (1 / wide), least), most))  # as many as keep the cells below the limit
    edges = cells.quantile_edges(rows, features, fine)
    found = cells.counted(rows, features, edges, [("label", k)])
    return None if found is None else _Rounds(found, k, edges)


def adaboost_fit(df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
                 learning_rate: float = 1.0, checkpoint_every: int = 10) -> AdaBoostModel:
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    features = list(features)
    ensure_checkpoint_dir(df.sparkSession)
    classes = sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().dropna().collect())
    K = len(classes)
    idx = F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]),
                       F.col(label).cast("string"))
    rows = df.select(*[_x(f).alias(f) for f in features], idx.alias("label")).dropna()
    on_cells = _rounds(rows, features, K)
    if on_cells is None:
        base = gathered(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows))
        n = base.count()
        cur = base.withColumn("w", F.lit(1.0 / n)).checkpoint(eager=True)
        base_ckpt, release = cur, None
    stumps, alphas = [], []
    for m in range(n_estimators):
        if on_cells is not None:
            rule, tot, bad = on_cells.stump()
        else:
            tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=SEED).fit(cur)
            rule = _stump_rule(tree)
            tot, bad = _leaf_weights(tree)
        err = bad / tot
        if err <= 0:
            stumps.append(rule)
            alphas.append(1.0)
            break
        if err >= 1.0 - 1.0 / K:
            if not stumps:
                raise ValueError("base learner no better than chance")
            break
        alpha = learning_rate * (math.log((1.0 - err) / err) + math.log(K - 1))
        stumps.append(rule)
        alphas.append(alpha)
        # new total weight in closed form: correct rows keep w, misclassified ones get w e^alpha
        s_new = (tot - bad) + bad * math.exp(alpha)
        if on_cells is not None:
            on_cells.reweight(alpha, s_new)
            continue
        pred = AdaBoostModel([rule], [1.0], [str(i) for i in range(K)], features)._stump_expr(rule)
        miss = (pred != F.col("label")).cast("double")
        nxt = cur.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * miss) / F.lit(s_new))
        if release is not None:
            release.unpersist()  # materialised by this round's fit, no longer read
        release = cur if cur is not base_ckpt else None
        if (m + 1) % checkpoint_every == 0:
            cur = nxt.checkpoint(eager=True)
        else:
            cur = nxt.persist(StorageLevel.MEMORY_AND_DISK)  # materialised by the next fit
    return AdaBoostModel(stumps, alphas, classes, features)


# ---------------------------------------------------------------------------
# RBF SVM via random Fourier features
# ---------------------------------------------------------------------------

class RBFSVMModel:
    def __init__(self, features, mean, std, W, b, svc, platt):
        self.features, self.mean, self.std, self.W, self.b, self.svc, self.platt = features, mean, std, W, b, svc, platt

    def _rff(self, df):
        from pyspark.ml.functions import array_to_vector
        z = [(_x(f) - F.lit(float(self.mean[i]))) / F.lit(float(self.std[i] or 1.0)) for i, f in enumerate(self.features)]
        D = self.W.shape[0]
        scale = math.sqrt(2.0 / D)
        W = [F.lit(self.W[:, j].copy()) for j in range(len(z))]

        def component(b, r):
            return F.lit(scale) * F.cos(sum((F.get(w, r) * z[j] for j, w in enumerate(W)), b))

        # one short expression over the literal weights: a term a component takes longer to plan than to compute
        return df.withColumn("features", array_to_vector(F.transform(F.lit(self.b), component)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction (class index) and, for two classes, probability of class 1
        by Platt scaling of the SVM margin."""
        out = self.svc.transform(self._rff(df))
        if self.platt is not None:
            from pyspark.ml.functions import vector_to_array
            a, c = self.platt
            margin = vector_to_array("rawPrediction")[1]
            out = out.withColumn("probability_1", 1.0 / (1.0 + F.exp(-(F.lit(a) * margin + F.lit(c)))))
        return out.drop("features")


def rbf_svm_fit(df: DataFrame, features: Sequence[str], label_idx: str = "label", n_components: int = 200,
                C: float = 1.0, seed: int = SEED) -> RBFSVMModel:
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    features = list(features)
    st = df.agg(*[F.avg(_x(f)).alias(f"m{i}") for i, f in enumerate(features)],
                *[F.stddev_pop(_x(f)).alias(f"s{i}") for i, f in enumerate(features)], F.count(F.lit(1)).alias("n")).first()
    mean = [st[f"m{i}"] for i in range(len(features))]
    std = [st[f"s{i}"] for i in range(len(features))]
    d = len(features)
    gamma = 1.0 / d  # 'scale' on standardised inputs: 1 / (d * Var) with Var = 1
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, d))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    model = RBFSVMModel(features, mean, std, W, b, None, None)
    data = model._rff(df.withColumn("label", F.col(label_idx).cast("double"))).select("label", "features")
    data = gathered(data)  # iterative solvers re-read it every pass
    n = st["n"]
    k = data.select("label").distinct().count()
    svc = LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=100)
    model.svc = (OneVsRest(classifier=svc) if k > 2 else svc).fit(data)
    if k == 2:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        m = model.svc.transform(data).withColumn("margin", vector_to_array("rawPrediction")[1])
        m = m.select("label", array_to_vector(F.array("margin")).alias("features"))
        lr = LogisticRegression(maxIter=100).fit(m)
        model.platt = (float(lr.coefficients[0]), float(lr.intercept))
    return model


# ---------------------------------------------------------------------------
# MLP regressor (E10): full-batch Adam with distributed gradients
# ---------------------------------------------------------------------------

class MLPRegressorModel:
    def __init__(self, features, mean, std, ymean, ystd, W1, b1, W2, b2, n_iter, losses):
        self.features, self.mean, self.std = features, mean, std
        self.ymean, self.ystd = ymean, ystd
        self.W1, self.b1, self.W2, self.b2 = W1, b1, W2, b2
        self.n_iter, self.losses = n_iter, losses

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """One JVM projection: relu(z W1 + b1) W2 + b2, unscaled."""
        z = [(_x(f) - F.lit(float(self.mean[i]))) / F.lit(float(self.std[i] or 1.0)) for i, f in enumerate(self.features)]
        hidden = []
        for h in range(self.W1.shape[1]):
            lin = sum((F.lit(float(self.W1[j, h])) * z[j] for j in range(len(z))), F.lit(float(self.b1[h])))
            hidden.append(F.greatest(lin, F.lit(0.0)) * F.lit(float(self.W2[h, 0])))
        y = sum(hidden[1:], hidden[0]) + F.lit(float(self.b2[0]))
        return df.withColumn(out, y * F.lit(self.ystd) + F.lit(self.ymean))


def mlp_regressor_fit(df: DataFrame, features: Sequence[str], label: str, hidden: int = 100, max_iter: int = 200,
                      lr: float = 1e-3, alpha: float = 1e-4, tol: float = 1e-4, n_iter_no_change: int = 10,
                      seed: int = SEED) -> MLPRegressorModel:
    """One hidden ReLU layer, squared loss + L2 (alpha), Adam. Inputs and target are
    standardised with training statistics. Each iteration is one Spark job: every
    partition returns its gradient sum (parameter-sized), the driver adds them and
    takes the Adam step; weights travel with the next task closure."""
    import pandas as pd

    features = list(features)
    d = len(features)
    st = df.agg(*[F.avg(_x(f)).alias(f"m{i}") for i, f in enumerate(features)],
                *[F.stddev_pop(_x(f)).alias(f"s{i}") for i, f in enumerate(features)],
                F.avg(_x(label)).alias("ym"), F.stddev_pop(_x(label)).alias("ys"), F.count(F.lit(1)).alias("n")).first()
    mean = [st[f"m{i}"] for i in range(d)]
    std = [st[f"s{i}"] or 1.0 for i in range(d)]
    ym, ys, n = st["ym"], st["ys"] or 1.0, st["n"]
    z = [((_x(f) - F.lit(mean[i])) / F.lit(std[i])).alias(f"z{i}") for i, f in enumerate(features)]
    data = df.select(*z, ((_x(label) - F.lit(ym)) / F.lit(ys)).alias("y")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(seed)
    lim1, lim2 = math.sqrt(6.0 / (d + hidden)), math.sqrt(6.0 / (hidden + 1))
    params = [rng.uniform(-lim1, lim1, (d, hidden)), rng.uniform(-lim1, lim1, hidden),
              rng.uniform(-lim2, lim2, (hidden, 1)), rng.uniform(-lim2, lim2, 1)]
    shapes = [p.shape for p in params]
    sizes = [p.size for p in params]
    m_t = [np.zeros_like(p) for p in params]
    v_t = [np.zeros_like(p) for p in params]
    b1_, b2_, eps = 0.9, 0.999, 1e-8
    best, stall, losses = float("inf"), 0, []
    zcols = [f"z{i}" for i in range(d)]
    for t in range(1, max_iter + 1):
        W1, c1, W2, c2 = params

        def grad(batches, W1=W1, c1=c1, W2=W2, c2=c2):
            acc = [np.zeros_like(W1), np.zeros_like(c1), np.zeros_like(W2), np.zeros_like(c2)]
            loss, cnt = 0.0, 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                X = pdf[zcols].to_numpy(dtype=np.float64)
                y = pdf["y"].to_numpy(dtype=np.float64)[:, None]
                H = np.maximum(X @ W1 + c1, 0.0)
                r = H @ W2 + c2 - y
                loss += float((r * r).sum())
                cnt += len(pdf)
                dH = (r @ W2.T) * (H > 0)
                acc[0] += X.T @ dH
                acc[1] += dH.sum(axis=0)
                acc[2] += H.T @ r
                acc[3] += r.sum(axis=0)
            flat = np.concatenate([a.ravel() for a in acc]).tolist()
            yield pd.DataFrame({"g": [flat], "loss": [loss], "n": [cnt]})

        parts = data.mapInPandas(grad, "g array<double>, loss double, n long").collect()
        G = np.sum([np.array(p["g"]) for p in parts], axis=0)
        nn = sum(p["n"] for p in parts)
        loss = sum(p["loss"] for p in parts) / (2 * nn) + alpha / (2 * nn) * (np.sum(W1 ** 2) + np.sum(W2 ** 2))
        losses.append(float(loss))
        grads, off = [], 0
        for shp, sz in zip(shapes, sizes):
            grads.append(G[off:off + sz].reshape(shp) / nn)
            off += sz
        grads[0] += alpha / nn * W1
        grads[2] += alpha / nn * W2
        lr_t = lr * math.sqrt(1 - b2_ ** t) / (1 - b1_ ** t)
        for i in range(4):
            m_t[i] = b1_ * m_t[i] + (1 - b1_) * grads[i]
            v_t[i] = b2_ * v_t[i] + (1 - b2_) * grads[i] ** 2
            params[i] = params[i] - lr_t * m_t[i] / (np.sqrt(v_t[i]) + eps)
        if loss > best - tol:
            stall += 1
            if stall >= n_iter_no_change:
                break
        else:
            stall = 0
        best = min(best, loss)
    data.unpersist()
    return MLPRegressorModel(features, mean, std, ym, ys, params[0], params[1], params[2], params[3], t, losses)
