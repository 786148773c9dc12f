"""Quality classifier (operator 11): regularised quadratic discriminant.

Every text becomes a vector of transformed statistics.  The labelled rows that
are not held out give each class a mean and a covariance, shrunk towards a round
one by the oracle-approximating rule; the score of a text is the logistic of the
prior log-odds plus the difference of the two Gaussian log-densities, computed
from Mahalanobis distances under the classes' Cholesky factors, which are found
once and cached.

Scale: a text is read once, into twenty numbers.  Learning is one join on doc_id
and one map-side combined aggregate of moments (two rows, whatever the input),
over all labelled rows; scoring is a pass over the numbers with two small
matrices.  Statistics are whole multiples of 1 / UNIT, so sums of them and of
their products are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, per_text

# One in so many documents (by CRC-32 of doc_id as text) is never learned from.
HELD_OUT = 5
# Scores from here on predict label 1.
LEAST_SCORE = 0.3
UNIT = 256
FEATURES = ("f_words", "f_length", "f_spread", "f_upper", "f_digits", "f_symbols", "f_exclaim", "f_stops",
            "f_distinct", "f_top", "f_lines", "f_triples", "f_entropy", "f_line_words")
# Variance added to each standardised feature, so that a constant one has a density.
FLOOR = 0.01
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]

_KIND = np.zeros(256, np.int64)  # byte -> upper, digit, symbol, exclamation, stop, other
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~_=+{}[]\\/", b"!?", b".,;:")):
    _KIND[list(_chars)] = _k + 1
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES; all are
    shares, means or logarithms, so that they stay bounded for any text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    cells = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = int(cells[~_SPACE].sum())
    kinds = np.bincount(_KIND, weights=cells, minlength=6)
    length = np.fromiter(map(len, words), np.int64, n)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    triples = 0.0
    if n >= 4:
        mixed = (code[:-2] * 1_000_003 + code[1:-1]) * 1_000_003 + code[2:]  # a rare clash only blurs the share
        triples = 1 - len(np.unique(mixed)) / (n - 2)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    share = cells[~_SPACE] / solid
    share = share[share > 0]
    root = lambda k: float(np.sqrt(kinds[k] / solid))
    got = [np.log1p(n), np.log(length.mean()), np.log1p(length.std()), root(1), root(2), root(3), root(4),
           np.sqrt(min(kinds[5] / n, 4.0)), np.log(n / len(ids)) / np.log(n + 1), np.sqrt(np.bincount(code).max() / n),
           np.sqrt(1 - len(set(lines)) / len(lines)), np.sqrt(triples), -(share * np.log2(share)).sum(),
           np.log1p(n / len(lines))]
    return (np.round(np.array(got) * UNIT) / UNIT).tolist()


@dataclass
class Discriminant:
    """Priors, means and Cholesky factors of both classes; ``shrinkage`` says how
    far each covariance was drawn to a round one."""
    prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    factor: list = field(default_factory=list)
    shrinkage: list = field(default_factory=list)

    @classmethod
    def learn(cls, count: np.ndarray, total: np.ndarray, product: np.ndarray) -> "Discriminant":
        """From the counts (2), sums (2 x d) and sums of products (2 x d x d) of the classes."""
        d, n = total.shape[1], count.sum()
        if not n:
            return cls(np.array([0.5, 0.5]), np.zeros(d), np.ones(d))
        mean = total.sum(0) / n
        var = np.einsum("kii->i", product) / n - mean * mean
        out = cls(count / n, mean, np.sqrt(np.maximum(var, 0)) + 1e-9)
        if not count.all():
            return out
        centre = total / count[:, None]
        for k in (0, 1):
            cov = (product[k] / count[k] - np.outer(centre[k], centre[k])) / np.outer(out.scale, out.scale)
            trace, square = np.trace(cov), (cov * cov).sum()
            # Oracle-approximating shrinkage (Chen et al., 2010) towards trace / d on the diagonal.
            spread = (count[k] + 1 - 2 / d) * (square - trace * trace / d)
            rho = 1.0 if spread <= 0 else min(1.0, ((1 - 2 / d) * square + trace * trace) / spread)
            cov = (1 - rho) * cov + (rho * trace / d + FLOOR) * np.eye(d)
            out.factor.append((centre[k], np.linalg.cholesky(cov)))
            out.shrinkage.append(rho)
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Prior log-odds plus the difference of the log-densities, of label 1."""
        if not self.factor:
            with np.errstate(divide="ignore"):
                return np.full(len(x), np.log(self.prior[1]) - np.log(self.prior[0]))
        part = []
        for k, (centre, low) in enumerate(self.factor):
            z = np.linalg.solve(low, ((x - centre) / self.scale).T)
            part.append(np.log(self.prior[k]) - np.log(np.diag(low)).sum() - 0.5 * (z * z).sum(0))
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of every row."""
    def make():
        def run(texts):
            got = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            return {f: got[:, i] for i, f in enumerate(FEATURES)}
        return run
    rows = per_text(docs, make, ", ".join(f"{f} double" for f in FEATURES))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False))
    return rows.withColumn("held_out", held)


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """The discriminant of the labelled rows that are not held out.  A document
    labelled both 0 and 1, or neither, teaches nothing; a repeated label counts once."""
    sure = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(label).alias("_label"), F.max(label).alias("_other")).where("_label = _other")
            .select(F.col("doc_id").alias("_doc"), "_label"))
    known = rows.where("NOT held_out").join(sure, F.col("doc_id") == F.col("_doc"))
    moments = known.groupBy("_label").agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in PAIRS])
    d = len(FEATURES)
    count, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in moments.collect():  # two rows at most
        k = int(r["_label"])
        count[k], total[k] = r["n"], [r[f"s{i}"] for i in range(d)]
        for i, j in PAIRS:
            product[k, i, j] = product[k, j, i] = r[f"s{i}_{j}"]
    return Discriminant.learn(count, total, product)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null, empty and blank texts have statistics of zero and are scored like any
    other; texts of any length are read whole.  If a class has no label to learn
    from, the score is the share of label 1 among those there are (0.5 without
    any).  A row without doc_id is not held out and never learned from; repeated
    rows and ids give a result row each and are learned from as often; an empty
    table gives no rows.  Only doc_id, text and the label are read, so extra
    columns of any name do no harm; language, source and labels enter no score.
    """
    rows = cut(with_statistics(docs))
    model = learn(rows, labels, label)
    out = T.StructType.fromDDL("doc_id bigint, held_out boolean, score double, predicted int")
    out.fields[0] = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(arrow.field(0).type), b.column("held_out"), pa.array(score),
                 pa.array((score >= least).astype(np.int32))], schema=arrow)

    return rows.mapInArrow(run, out)
