"""Isolation forest as Spark jobs.

1. one aggregate: row count and per-feature means (nulls -> mean);
2. per-tree samples of psi rows: one hash per row; each tree owns a
   window of the hash range, so a row's trees follow by arithmetic and
   ``row_number() <= psi`` picks each sample (partial group limit before
   the shuffle);
3. ``groupBy(tree).applyInPandas`` grows one tree per group (psi rows);
4. the forest (at most trees x (2 psi - 1) nodes - a bound fixed by the
   parameters, not the data) is broadcast, and ``mapInPandas`` scores
   every row in Arrow batches;
5. key + score are written once to the shared folder, the cut is the
   (1 - contamination) percentile of the scores, outliers score above it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.kinds import as_double, numeric_columns, q
from quarry.session import materialize, ship_package

EULER = 0.5772156649


def avg_path_length(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful search in a BST."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def grow_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int) -> np.ndarray:
    """Nodes as rows (feature, threshold, left, right, size); feature -1 = leaf."""
    nodes: list[list] = []

    def grow(idx, depth):
        nid = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return nid
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return nid
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[nid][0], nodes[nid][1] = f, thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        nodes[nid][2], nodes[nid][3] = left, right
        return nid

    grow(np.arange(len(X)), 0)
    return np.array(nodes, dtype=float)


def path_lengths(X: np.ndarray, tree: np.ndarray, max_depth: int) -> np.ndarray:
    """Vectorised descent of all rows of X through one tree."""
    return forest_path_lengths(X, stack_forest([tree]), max_depth)[:, 0]


def stack_forest(trees: list) -> tuple:
    """Flatten trees for fast descent: leaves loop to themselves (threshold
    +inf), children are interleaved in one array, and each node carries its
    finished path length depth + c(size) so no per-level bookkeeping is
    needed."""
    feats, thrs, childs, paths, roots = [], [], [], [], []
    off = 0
    for t in trees:
        m = len(t)
        f = t[:, 0].astype(np.int64)
        leaf = f < 0
        left = np.where(leaf, np.arange(m), t[:, 2]).astype(np.int64) + off
        right = np.where(leaf, np.arange(m), t[:, 3]).astype(np.int64) + off
        depth = np.zeros(m)
        for i in range(m):                       # parents precede children
            if not leaf[i]:
                depth[int(t[i, 2])] = depth[i] + 1
                depth[int(t[i, 3])] = depth[i] + 1
        feats.append(np.where(leaf, 0, f))
        thrs.append(np.where(leaf, np.inf, t[:, 1]))
        childs.append(np.stack([left, right], axis=1).ravel())
        paths.append(depth + avg_path_length(t[:, 4]))
        roots.append(off)
        off += m
    return (np.concatenate(feats), np.concatenate(thrs), np.concatenate(childs),
            np.concatenate(paths), np.array(roots, dtype=np.int64))


def forest_path_lengths(X: np.ndarray, forest: tuple, max_depth: int) -> np.ndarray:
    """h(x) for every row and tree at once: (rows, trees) matrix.  Each
    level is four gathers over all (row, tree) pairs."""
    feat, thr, child, path, roots = forest
    n, d = X.shape
    flat = np.ascontiguousarray(X, dtype=float).ravel()
    base = (np.arange(n, dtype=np.int64) * d)[:, None]
    node = np.broadcast_to(roots, (n, len(roots))).copy()
    for _ in range(max_depth):
        go_right = flat[base + feat[node]] >= thr[node]
        node = child[2 * node + go_right]
    return path[node]


def _uniform(*cols):
    h = F.xxhash64(*cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def isolation_scores(df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None,
                     n_trees: int = 100, sample_size: int = 256, seed: int = 42) -> DataFrame:
    """Score every row: (key..., score) with score = 2^(-E[h(x)] / c(psi))."""
    key = list(key)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or numeric_columns(df)) if c not in key]
    spark = df.sparkSession
    ship_package(spark)
    st = df.agg(F.count(F.lit(1)).alias("_n"),
                *[F.avg(as_double(c, types[c])).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = st["_n"]
    feats = [(c, st[f"m{i}"]) for i, c in enumerate(cols) if st[f"m{i}"] is not None]
    if n == 0 or not feats:
        return spark.createDataFrame([], ", ".join([f"`{k}` {types[k].simpleString()}" for k in key]
                                                   + ["score double"]))
    names = [f"f{i}" for i in range(len(feats))]
    X = df.select(*[q(k) for k in key],
                  *[F.coalesce(as_double(c, types[c]), F.lit(float(m))).alias(nm)
                    for (c, m), nm in zip(feats, names)])
    psi = min(sample_size, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    # per-tree samples from ONE hash per row: u ~ U[0,1); tree t owns the
    # window [t/T, t/T + p) of u (wrapping), p = 2 psi / n, so each tree
    # sees about 2 psi uniform candidates and keeps the psi smallest offsets.
    # For large n the windows are disjoint (p < 1/T) and a row belongs to at
    # most one tree; the pre-filter keeps only ~p*n*T rows.
    T = n_trees
    p = min(1.0, 2.0 * psi / n)
    u = _uniform(*[q(k) for k in key], F.lit(seed))
    d0 = (u * F.lit(float(T)) - F.floor(u * F.lit(float(T)))) / F.lit(float(T))   # offset in own window
    t0 = F.floor(u * F.lit(float(T))).cast("int")
    cand = X.select("*", d0.alias("_d0"), t0.alias("_t0")).where(F.col("_d0") < F.lit(p))
    k = F.ceil((F.lit(p) - F.col("_d0")) * F.lit(float(T))).cast("int")
    per_tree = (cand.select("*", F.explode(F.sequence(F.lit(0), F.least(k, F.lit(T)) - 1)).alias("_j"))
                .select("*", F.pmod(F.col("_t0") - F.col("_j"), F.lit(T)).alias("tree"),
                        (F.col("_d0") + F.col("_j") / F.lit(float(T))).alias("u"))
                .where(F.col("u") < F.lit(p)))
    w = Window.partitionBy("tree").orderBy("u", *key)
    sample = per_tree.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi) \
        .select("tree", *names)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        nodes = grow_tree(pdf[names].to_numpy(dtype=float), rng, max_depth)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "size"])
        out.insert(0, "node", np.arange(len(nodes)))
        out.insert(0, "tree", t)
        return out

    # an explicit repartition by tree is not coalesced by AQE, so the trees
    # grow in parallel Python workers (groupBy reuses this partitioning)
    par = spark.sparkContext.defaultParallelism
    forest = sample.repartition(min(par, n_trees), "tree").groupBy("tree").applyInPandas(
        build, "tree int, node long, feature double, threshold double, left double, right double, size double")
    nodes = forest.orderBy("tree", "node").toPandas()      # <= n_trees * (2 psi - 1) rows
    tree_arrays = [g[["feature", "threshold", "left", "right", "size"]].to_numpy()
                   for _, g in nodes.groupby("tree", sort=True)]
    bc = spark.sparkContext.broadcast((stack_forest(tree_arrays), max_depth,
                                       float(avg_path_length(psi))))
    key_schema = [f"`{k}` {types[k].simpleString()}" for k in key]

    def score(batches):
        forest, depth, c_psi = bc.value
        for pdf in batches:
            Xb = pdf[names].to_numpy(dtype=float)
            h = forest_path_lengths(Xb, forest, depth).mean(axis=1)
            out = pdf[key].copy()
            out["score"] = np.power(2.0, -h / c_psi)
            yield out

    return X.mapInPandas(score, ", ".join(key_schema + ["score double"]))


def isolation_forest(df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None,
                     n_trees: int = 100, sample_size: int = 256, contamination: float = 0.05,
                     seed: int = 42, method: str = "exact"):
    """Returns (scores, cut) where ``scores`` (key..., score,
    is_outlier) is materialised in the shared folder and ``cut`` is the
    score percentile at 1 - contamination (exact distributed selection, or
    a bounded sketch with ``method='approx'``)."""
    from quarry.functions.quantiles import exact_quantiles
    s = materialize(isolation_scores(df, key, cols, n_trees, sample_size, seed), "iforest-scores")
    p = 1.0 - contamination
    if method == "approx":
        cut = s.agg(F.percentile_approx("score", p, 100000)).first()[0]
    else:
        cut = exact_quantiles(s, {"score": F.col("score")}, [p])[("score", p)]
    cut = float("inf") if cut is None else cut
    return s.withColumn("is_outlier", F.col("score") > F.lit(cut)), cut


def outliers_isolation(df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None,
                       contamination: float = 0.05, seed: int = 42, n: int = 10):
    """E3 report: (count frame, first ``n`` outlier rows by key with score).
    The first rows are joined back through at most ``n`` keys."""
    key = list(key)
    scores, _ = isolation_forest(df, key, cols, contamination=contamination, seed=seed)
    out = scores.where("is_outlier")
    count = out.agg(F.count(F.lit(1)).alias("outliers"))
    first = out.orderBy(*key).limit(n).select(*key, "score")
    rows = df.join(F.broadcast(first), key).orderBy(*key)
    return count, rows
