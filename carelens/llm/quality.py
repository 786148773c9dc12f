"""Quality rules (operator 8): fixed base rules plus robust multivariate outliers.

Every document becomes a vector of transformed statistics.  For each language
and source, each language, and all rows, a minimum-covariance-determinant
estimate is sought among several starts: the quartiles of each feature, and
small disjoint subsets drawn by a hash of the id.  A concentration step keeps the
``COVERAGE`` share of rows with the smallest Mahalanobis distance and takes their
mean and covariance again, which never raises the determinant.  All starts take
``SHORT_STEPS`` steps over all rows, the one with the least determinant goes on
until no determinant falls by more than ``SETTLED``.  A constant feature would
make every determinant zero, so the square of what one text of ``MIN_WORDS``
words can resolve is added to the variances (the regularised estimate of
Boudt et al., 2020).

A group's estimate is mixed with that of its language, and this with that of all
rows, as if the wider one were worth ``PRIOR_ROWS`` rows of its own: few rows
say little, and there is no size at which a group's verdicts change at once.
Rows are rejected whose squared distance a normal vector exceeds with
probability ``LEVEL``.

Scale: the text is read once; what follows works on the checkpointed
statistics.  Each step is two map-side combined aggregates (a fixed-size
distance histogram per group and start, then moments), so a group holding a third
of all rows costs no more in any task than the others, and nothing but the
greatest fall of a determinant reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, document_key, per_text, without

SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
# Share of a group's rows that its estimate rests on (the h of the MCD).
COVERAGE = 0.75
# Probability that a normal vector is beyond the cut-off.
LEVEL = 1e-4
# Starts of a group (quartiles and hashed subsets of about START_ROWS rows), steps
# of each, most steps of the best, and the fall of a log determinant that counts.
STARTS, START_ROWS, SHORT_STEPS, MOST_STEPS, SETTLED = 5, 25, 2, 10, 1e-3
# What the wider group's estimate weighs, in rows.
PRIOR_ROWS = 100
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeat")
# What a text of MIN_WORDS words resolves of each feature: a word, the sampling error
# of the mean word length (about half of it for one word), a symbol, a line, a repeated window.
FLOORS = (1 / MIN_WORDS, 0.5 / math.sqrt(MIN_WORDS), math.log1p(10 / MIN_WORDS), math.log(2), 6 / MIN_WORDS)
# Features are whole multiples of 1 / UNIT, so that sums do not depend on order.
UNIT = 1024
# Histogram cells for log2(1 + squared distance), per unit.
CELLS = 256
# Estimates take about 200 bytes a group; more than so many are not broadcast.
BROADCAST_GROUPS = 50_000
SALTS = 64
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
MEANS, INVERSE = [f"m{i}" for i in range(len(FEATURES))], [f"v{i}{j}" for i, j in PAIRS]


def beyond(x: float, odd: int) -> float:
    """Probability that chi-square with an odd number of degrees exceeds ``x``."""
    term = total = 1.0
    for k in range(1, (odd - 1) // 2):
        term *= x / (2 * k + 1)
        total += term
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def quantile(p: float, odd: int) -> float:
    """The value that chi-square exceeds with probability ``p``, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid, odd) > p else (low, mid)
    return high


# 25.7 for 5 features, and what makes the covariance of the nearest share consistent.
CUTOFF = quantile(LEVEL, len(FEATURES))
CONSISTENCY = COVERAGE / (1 - beyond(quantile(1 - COVERAGE, len(FEATURES)), len(FEATURES) + 2))


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS.encode())), 0, 0
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        if len(ids) < 2_000_000:  # three ids fit one 64-bit key
            key = (code[:-2] * len(ids) + code[1:-1]) * len(ids) + code[2:]
        else:
            key = np.unique(np.stack([code[:-2], code[1:-1], code[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(n - 2, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        word = np.zeros(n, bool)
        for k in range(3):
            word[k:n - 2 + k] |= hit
        repeat = int(word.sum())
    return n, chars, symbols, dup, repeat


def with_statistics(docs: DataFrame, keep=("doc_id", "lang", "source")) -> DataFrame:
    def make():
        def run(texts):
            got = [statistics(t) for t in texts]
            return {n: [g[i] for g in got] for i, n in enumerate(
                ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        return run
    return per_text(docs, make, STATS, tuple(keep))


def _vectors(stats: DataFrame) -> DataFrame:
    """Base verdict, the five transformed statistics, the groups ``_levels`` whose
    estimates a row takes part in (its language and source, its language, all rows),
    the first of which, ``_g``, judges it, and ``_draw``, which deals it to starts."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.to_json(F.array(name("lang"), name("source")))
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = {"f_words": F.log1p("n_words"), "f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
           "f_symbols": F.log1p(10 * F.col("n_symbols") / words), "f_lines": F.log1p("n_dup_lines"),
           "f_repeat": F.col("n_repeat_words") / words}
    return stats.withColumns(
        {"base_failed": (F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
         "_g": own, "_levels": F.array(own, F.to_json(F.array(name("lang"))), F.lit("[]")),
         "_draw": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))}
        | {k: F.round(e * UNIT) / UNIT for k, e in raw.items()})


def _matrices(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    """Symmetric matrices, one a row, from the columns prefix + ij."""
    out = np.empty((batch.num_rows, len(FEATURES), len(FEATURES)))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = batch.column(f"{prefix}{i}{j}").to_numpy(zero_copy_only=False)
    return out


def _vectors_of(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    return np.stack([batch.column(f"{prefix}{i}").to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], 1)


def _estimates(groups: DataFrame, run) -> DataFrame:
    """(_g, _k, rows, det, mean m_i, inverse covariance v_ij): ``run`` gives means and
    covariances of an Arrow batch of groups, det is the logarithm of their determinant."""
    out = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_k", T.IntegerType())]
                       + [T.StructField(c, T.DoubleType()) for c in ("rows", "det", *MEANS, *INVERSE)])
    arrow = to_arrow_schema(out)

    def estimate(batches):
        for b in batches:
            mean, cov = run(b)
            inv = np.linalg.inv(cov)
            yield pa.RecordBatch.from_arrays(
                [b.column("_g").cast(pa.string()), b.column("_k").cast(pa.int32()), b.column("rows").cast(pa.float64()),
                 pa.array(np.linalg.slogdet(cov)[1], type=pa.float64())]
                + [pa.array(mean[:, i]) for i in range(len(FEATURES))]
                + [pa.array(np.ascontiguousarray(inv[:, i, j])) for i, j in PAIRS], schema=arrow)

    return groups.mapInArrow(estimate, out)


def _with_inverse(groups: DataFrame) -> DataFrame:
    """Estimates from the sums s_i, s_ij over n of a group's rows."""
    floor = np.diag(np.square(FLOORS))

    def run(b):
        n = b.column("n").to_numpy(zero_copy_only=False)
        mean = _vectors_of(b, "s") / n[:, None]
        cov = _matrices(b, "s") / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        return mean, CONSISTENCY * cov + floor

    return _estimates(groups, run)


def _mixed(groups: DataFrame, wider: DataFrame) -> DataFrame:
    """The estimates of ``groups`` mixed with those of the ``wider`` groups they lie
    in: weighted means and covariances, the wider one counting as PRIOR_ROWS rows.
    (The gap between the two means adds nothing, or a few odd rows alone in their
    group would make room for themselves.)"""
    parts = F.from_json("_g", "array<string>")
    inside = F.when(F.size(parts) == 2, F.to_json(F.array(F.get(parts, F.lit(0))))).otherwise(F.lit("[]"))
    wide = wider.select(F.col("_g").alias("_in"), *[F.col(c).alias(f"w{c}") for c in (*MEANS, *INVERSE)])

    def run(b):
        n = b.column("rows").to_numpy(zero_copy_only=False)
        own = (n / (n + PRIOR_ROWS))[:, None, None]
        mean = own[:, 0] * _vectors_of(b, "m") + (1 - own[:, 0]) * _vectors_of(b, "wm")
        return mean, own * np.linalg.inv(_matrices(b, "v")) + (1 - own) * np.linalg.inv(_matrices(b, "wv"))

    return cut(_estimates(_attached(groups.withColumn("_in", inside), wide, "inner", ("_in",)), run))


def _distance(v: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``distance``, the squared Mahalanobis distance under each estimate of the group."""
    d = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    total = sum((F.col(f"v{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))
    return _attached(v, params.drop("rows", "det"), how).withColumn("distance", total).drop(*MEANS, *INVERSE)


def _attached(v: DataFrame, groups: DataFrame, how: str, on: tuple = ("_g",)) -> DataFrame:
    """Rows with what ``groups`` (checkpointed, one row a group) has for them:
    broadcast while the groups are known to be few, else joined on group and
    salt, so that a hot group's rows meet in no single task."""
    if groups.count() <= BROADCAST_GROUPS:
        return v.join(F.broadcast(groups), [*on], how)
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    salted = v.withColumn("_salt", F.pmod(F.xxhash64(*v.columns), F.lit(SALTS)))
    return salted.join(groups.withColumn("_salt", salt), [*on, "_salt"], how).drop("_salt")


def _sums() -> dict:
    return ({f"s{i}": F.col(f) for i, f in enumerate(FEATURES)}
            | {f"s{i}{j}": F.col(FEATURES[i]) * F.col(FEATURES[j]) for i, j in PAIRS})


def _starts(v: DataFrame) -> DataFrame:
    """First estimates of every group: a diagonal one from median and quartile
    range of every feature (_k = 0), and those of the hashed subsets (_k > 0)."""
    cells = (v.select("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f).alias("x"))
                                                for i, f in enumerate(FEATURES)])).alias("e"))
             .groupBy("_g", "e.k", "e.x").count())
    w = Window.partitionBy("_g", "k")
    cum = cells.withColumns({"_c": F.sum("count").over(w.orderBy("x")), "_n": F.sum("count").over(w)})
    at = cum.groupBy("_g", "k").agg(F.max("_n").alias("n"),
                                    *[F.min(F.when(F.col("_c") >= q * F.col("_n"), F.col("x"))).alias(f"q{i}")
                                      for i, q in enumerate((0.25, 0.5, 0.75))])
    spread = {i: F.greatest((F.col("q2") - F.col("q0")) / 1.349, F.lit(FLOORS[i])) for i in range(len(FEATURES))}
    pick = lambda i, e: F.max(F.when(F.col("k") == i, e))
    quartiles = cut(at.groupBy("_g").agg(
        F.lit(0).alias("_k"), F.max("n").cast("double").alias("rows"), F.lit(0.0).alias("det"),
        *[pick(i, F.col("q1")).alias(f"m{i}") for i in range(len(FEATURES))],
        *[(pick(i, 1 / (spread[i] * spread[i])) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS]))
    deal = F.pmod("_draw", F.greatest(F.floor(F.col("rows") / START_ROWS), F.lit(1)))
    drawn = (_attached(v, quartiles.select("_g", "rows"), "inner").withColumn("_k", (deal + 1).cast("int"))
             .where(F.col("_k") < STARTS).groupBy("_g", "_k")
             .agg(F.first("rows").alias("rows"), F.count("*").cast("double").alias("n"),
                  *[F.sum(e).alias(k) for k, e in _sums().items()]))
    return quartiles.unionByName(_with_inverse(drawn))


def _concentrate(v: DataFrame, params: DataFrame) -> DataFrame:
    """One C-step: moments of the COVERAGE share of rows nearest to each estimate.
    Rows are summed per distance cell first (a bounded number of cells a group),
    so the share is cut at a cell's edge."""
    d = _distance(v, params).withColumn("_cell", F.floor(F.log2(1 + F.col("distance")) * CELLS))
    sums = _sums()
    cells = d.groupBy("_g", "_k", "_cell").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    w = Window.partitionBy("_g", "_k")
    near = cells.withColumns({
        "_before": F.sum("n").over(w.orderBy("_cell")) - F.col("n"), "_all": F.sum("n").over(w)}).where(
        F.col("_before") < COVERAGE * F.col("_all"))
    return _with_inverse(near.groupBy("_g", "_k").agg(
        F.max("_all").cast("double").alias("rows"), F.sum("n").cast("double").alias("n"),
        *[F.sum(k).alias(k) for k in sums]))


def _least(params: DataFrame) -> DataFrame:
    """Of every group the estimate of least determinant (ties: first start), as
    start 0, and how far it lies below that of start 0 so far, as ``fall``."""
    best = params.groupBy("_g").agg(
        F.min_by(F.struct("rows", "det", *MEANS, *INVERSE), F.struct("det", "_k")).alias("b"),
        (F.max(F.when(F.col("_k") == 0, F.col("det"))) - F.min("det")).alias("fall"))
    return best.select("_g", F.lit(0).alias("_k"), "b.*", "fall")


def _fit(passed: DataFrame) -> DataFrame:
    """The least-determinant estimate of every group in ``_g``."""
    params = cut(_starts(passed))
    for _ in range(SHORT_STEPS):
        params = cut(_concentrate(passed, params))
    params = cut(_least(params)).drop("fall")
    for _ in range(MOST_STEPS):
        after = _concentrate(passed, params).withColumn("_k", F.lit(1))
        params = cut(_least(params.unionByName(after)))
        fall = params.agg(F.max("fall")).first()[0]
        params = params.drop("fall")
        if fall is None or fall < SETTLED:
            break
    return params


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, distance of every row.

    Null text counts as empty (base_failed); null language or source as an empty
    name.  Repeated rows and ids give a result row each; ties in distance share
    a verdict; an empty table gives no rows; only doc_id, lang, source and text
    are read, so extra columns of any name are ignored.
    """
    # A row that fails the base rules takes no part in the estimates.
    v = cut(_vectors(with_statistics(docs)))
    params = _fit(v.where("NOT base_failed").select(F.explode("_levels").alias("_g"), "_draw", *FEATURES))
    level = F.size(F.from_json("_g", "array<string>"))
    languages = _mixed(params.where(level == 1), params.where(level == 0))
    own = _mixed(params.where(level == 2), languages)
    return _distance(v, own.drop("_k"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"), "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were.  Rows
    that repeat a doc_id are one document, rejected if any of them is; so are rows
    without doc_id that repeat a text."""
    key = document_key()
    return without(docs, judge(docs.withColumn("doc_id", key)).where("NOT kept").select(F.col("doc_id").alias("_bad")), key)
