"""Per-row SHAP values of the boosted trees (I12) and their global mean.

Path-dependent TreeSHAP (Lundberg et al., 2018) in closed form per leaf: a
leaf reached through features P (|P| <= depth) contributes, for i in P,
  v * sum_{S in P\\{i}} |S|!(|P|-|S|-1)!/|P|! * prod_{j in S} o_j * prod_{j in P\\S\\{i}} z_j * (o_i - z_i)
where o_j is 1 when the row satisfies every split on j along the path and
z_j the product of the cover ratios of those splits.

That depends on a row only through the bins its features fall into, between
the distinct thresholds of the model.  So the leaves of all trees that share a
set of features are added up, when the model is compiled, into grids over the
bins of these features (at most ``CELLS`` cells; more leaves start another
grid).  A row then costs one search for the bin of each feature and, for each
grid, one look-up a feature: column expressions over literal arrays, all in
the JVM.  The tree table (trees x 2^(depth+1) nodes, a fixed bound) is read
from the saved model.  Values are in log-odds, where MLlib's margin F gives
p = 1 / (1 + exp(-2F)).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TRUST_FEATURES, TRUST_FLAG_BELOW
from .trust import _filled

# Cells of one grid (a leaf alone needs 2^depth at most).
CELLS = 4096


def tree_table(spark, model_path: str, model):
    """(tree weights, nodes) of the GBT stage of a PipelineModel saved at
    ``model_path``: the nodes from its Parquet data, the weights from the model."""
    # PipelineModel writes stage i as stages/<i>_<uid>: no listing needed,
    # so the path may be any Hadoop file system URI.
    i, stage = next((i, st) for i, st in enumerate(model.stages) if "GBT" in type(st).__name__)
    nodes = spark.read.parquet(f"{model_path.rstrip('/')}/stages/{i}_{stage.uid}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold")).collect()
    return dict(enumerate(float(w) for w in stage.treeWeights)), [r.asDict() for r in nodes]


def compile_leaves(weights: dict, nodes: list) -> list:
    """Per leaf: (tree weight * value, features, per-feature edge lists, z)."""
    by_tree: dict = {}
    for n in nodes:
        by_tree.setdefault(int(n["treeID"]), {})[int(n["id"])] = n
    leaves = []
    for t, tree in by_tree.items():
        w = weights[t]
        root = min(tree)

        def walk(nid, path):
            n = tree[nid]
            if n["leftChild"] < 0:
                feats = sorted({f for f, _, _, _ in path})
                edges = {f: [(thr, left) for ff, thr, left, _ in path if ff == f] for f in feats}
                z = {f: math.prod(r for ff, _, _, r in path if ff == f) for f in feats}
                leaves.append((w * float(n["prediction"]), feats, edges, z))
                return
            cover = float(n["rawCount"]) or 1.0
            for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
                r = float(tree[child]["rawCount"]) / cover
                walk(child, path + [(int(n["featureIndex"]), float(n["threshold"]), left, r)])
        walk(root, [])
    return leaves


def _weights(d: int) -> list:
    return [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]


def leaf_tables(leaves: list) -> list:
    """For each leaf, the contribution to each of its d features for every
    pattern of the d path conditions (bit k set = row satisfies the splits on
    feature k): a (2^d, d) table."""
    out = []
    for v, feats, edges, z in leaves:
        d = len(feats)
        if d == 0:
            out.append((v, feats, edges, None, v))
            continue
        wts = _weights(d)
        table = np.zeros((1 << d, d))
        for pat in range(1 << d):
            o = [(pat >> k) & 1 for k in range(d)]
            for a in range(d):
                others = [k for k in range(d) if k != a]
                acc = 0.0
                for r in range(len(others) + 1):
                    for S in itertools.combinations(others, r):
                        term = wts[r]
                        for k in others:
                            term *= o[k] if k in S else z[feats[k]]
                        acc += term
                table[pat, a] = v * acc * (o[a] - z[feats[a]])
        out.append((v, feats, edges, table, v * math.prod(z[f] for f in feats)))
    return out


def compile_model(tables: list) -> dict:
    """``thresholds``: the distinct ones of each feature, ascending; ``grids``: of each
    grid its features, an array per feature that gives each bin its share of the cell
    number, and the values of each feature by cell; ``base``: the expected value."""
    base = sum(expected for *_, expected in tables)
    seen: dict = {}
    for _, feats, edges, _, _ in tables:
        for f in feats:
            seen.setdefault(f, set()).update(t for t, _ in edges[f])
    thresholds = {f: sorted(ts) for f, ts in sorted(seen.items())}
    by_set: dict = {}
    for _, feats, edges, table, _ in tables:
        if table is not None:
            # Bin b of a feature holds the values above b of its thresholds: x <= thresholds[k] where b <= k.
            at = [[(thresholds[f].index(t), left) for t, left in edges[f]] for f in feats]
            by_set.setdefault(tuple(feats), []).append((at, table))
    grids = []
    for feats, leaves in by_set.items():
        held, cuts = [], [set() for _ in feats]
        for at, table in sorted(leaves, key=lambda leaf: leaf[0]):
            wider = [c | {k for k, _ in a} for c, a in zip(cuts, at)]
            if held and math.prod(len(c) + 1 for c in wider) > CELLS:
                grids.append(_grid(feats, held, cuts, thresholds))
                held, wider = [], [{k for k, _ in a} for a in at]
            held.append((at, table))
            cuts = wider
        grids.append(_grid(feats, held, cuts, thresholds))
    return {"thresholds": thresholds, "grids": grids, "base": base}


def _grid(feats: tuple, leaves: list, cuts: list, thresholds: dict) -> tuple:
    """(features, place of each bin by feature, values of each cell by feature) of the
    sum of ``leaves``, whose splits lie at the thresholds numbered ``cuts``."""
    cuts = [sorted(c) for c in cuts]
    shape = [len(c) + 1 for c in cuts]
    values = np.zeros((len(feats), *shape))
    for at, table in leaves:
        pattern = np.zeros(shape, np.int64)
        for k, (a, c) in enumerate(zip(at, cuts)):
            cell = np.arange(len(c) + 1)
            ok = np.ones(len(c) + 1, bool)
            for bin_, left in a:
                below = cell <= c.index(bin_)
                ok &= below if left else ~below
            pattern += (ok.astype(np.int64) << k).reshape([-1 if i == k else 1 for i in range(len(cuts))])
        values += np.moveaxis(table[pattern], -1, 0)
    strides = [math.prod(shape[k + 1:]) for k in range(len(shape))]
    places = [np.searchsorted(c, np.arange(len(thresholds[f]) + 1)) * s for f, c, s in zip(feats, cuts, strides)]
    return feats, places, values.reshape(len(feats), -1)


def _literal(numbers, kind: str) -> str:
    """SQL of a literal array; the text is folded into one when the plan is optimised."""
    return f"cast(split('{','.join(map(repr, numbers.tolist()))}', ',') AS array<{kind}>)"


def _bin(x: Column, thresholds: list, low: int, high: int) -> Column:
    """The number of thresholds below ``x`` (all for NaN), which is known to lie in low..high."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x <= thresholds[mid], _bin(x, thresholds, low, mid)).otherwise(_bin(x, thresholds, mid + 1, high))


def with_shap(rows: DataFrame, model: dict, features: str, n: int) -> DataFrame:
    """Add ``_phi_0`` .. ``_phi_<n - 1>``, the SHAP values (log-odds) of the ``n`` values of
    the array column ``features``; neither null nor an array of another length is expected."""
    keep = rows.columns
    bins = rows.select(*keep, *[_bin(F.get(features, F.lit(f)), t, 0, len(t)).alias(f"_bin_{f}")
                                for f, t in model["thresholds"].items()])
    # One SQL text a column: thousands of Column calls would take seconds.
    cells = bins.select(*keep, *[
        F.expr(" + ".join(f"get({_literal(p, 'int')}, _bin_{f})" for f, p in zip(feats, places))).alias(f"_cell_{i}")
        for i, (feats, places, _) in enumerate(model["grids"])])
    terms: dict = {}
    for i, (feats, _, values) in enumerate(model["grids"]):
        for f, v in zip(feats, values):
            terms.setdefault(f, []).append(f"get({_literal(2.0 * v, 'double')}, _cell_{i})")
    return cells.select(*keep, *[F.expr(" + ".join(terms.get(f, ["0D"]))).alias(f"_phi_{f}") for f in range(n)])


_COMPILED: dict = {}


def compiled_model(spark, model_path: str, model) -> dict:
    """Tree tables of a saved model, compiled once per model, path and application."""
    # A refit saved to the same path is another model.
    key = (spark.sparkContext.applicationId, model_path, model.uid)
    if key not in _COMPILED:
        _COMPILED[key] = compile_model(leaf_tables(compile_leaves(*tree_table(spark, model_path, model))))
    return _COMPILED[key]


def explain_trust(features: DataFrame, model, model_path: str, digits: int | None = 4,
                  calibration=None) -> DataFrame:
    """I11 + I12: score rows (calibrated if asked, rounded to one digit before the flag) and
    attach SHAP values as map<feature, value> and the base value."""
    from pyspark.ml.functions import vector_to_array

    from ..session import small_methods
    small_methods(features.sparkSession)   # hundreds of look-ups are one long method otherwise
    compiled = compiled_model(features.sparkSession, model_path, model)
    p = vector_to_array("probability")[1]
    p = p if calibration is None else calibration.column(p)
    scored = model.transform(_filled(features)).select(
        "hadm_id", vector_to_array("features").alias("_x"), F.round((1 - p) * 100, 1).alias("trust_score"),
        # MLlib's margin F gives p = 1 / (1 + exp(-2F)): finite where p rounds to 0 or 1.
        (2 * vector_to_array("rawPrediction")[1]).alias("margin"))
    value = lambda f: F.col(f"_phi_{f}") if digits is None else F.round(f"_phi_{f}", digits)
    return with_shap(scored, compiled, "_x", len(TRUST_FEATURES)).select(
        "hadm_id", "trust_score", (F.col("trust_score") < TRUST_FLAG_BELOW).alias("dq_flag"),
        F.lit(2.0 * compiled["base"]).alias("base_value"), "margin",
        F.create_map(*[c for f, name in enumerate(TRUST_FEATURES) for c in (F.lit(name), value(f))]).alias("shap_values"))


def global_importance(shap: DataFrame) -> DataFrame:
    """D16 + F4: mean absolute SHAP value per feature, largest first."""
    # One aggregate a feature: exploding the map would make the optimiser infer a filter on it,
    # which repeats the whole explanation as one expression below it.
    each = shap.agg(*[F.avg(F.abs(F.col("shap_values")[f])).alias(f) for f in TRUST_FEATURES])
    return (each.unpivot([], TRUST_FEATURES, "feature", "importance").where("importance IS NOT NULL")
            .orderBy(F.desc("importance"), "feature"))
