"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel on the standardised statistics. The
normal equations are summed within partitions of the training rows and added up; solving them gives
ridge scores. Two halves of the training rows score each other, and pooling adjacent violators over
these scores makes them probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .arrays import Words, give_back, in_small_batches, windows

CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32),
    "line": (10,), "stop": (46, 44, 59, 58), "loud": (33, 63), "hash": (35,), "dollar": (36,), "percent": (37,),
    "amper": (38,), "star": (42,), "bar": (124,), "angle": (60, 62), "bracket": (40, 41, 91, 93, 123, 125),
    "high": range(128, 256), "slash": (47, 92, 95, 64), "control": (*range(9), *range(14, 32), 127),
}
NAMES = [*CLASSES, "chars", "words", "mean_word", "long_word", "distinct", "repeat3", "lines", "repeat_lines", "capital", "ended"]
COLUMNS = [f"s_{n}" for n in NAMES]


def per_text(values, of, n) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n)


def share_distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text over all its values; 1 for a text without any."""
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    total = np.bincount(of, minlength=n)
    return np.where(total > 0, np.bincount(o[new], minlength=n) / np.maximum(total, 1), 1.0)


def statistics(texts) -> np.ndarray:
    """One row of figures for each text, all in [0, 1] or logarithms; an empty text has defined ones too."""
    words = Words(texts)
    n = len(words.offsets) - 1
    size = np.diff(words.offsets)
    table = np.zeros((len(CLASSES), 256), bool)
    for k, codes in enumerate(CLASSES.values()):
        table[k, list(codes)] = True
    # counts of all byte values of each text, a text at a time: the texts are much longer than 256
    counts = np.stack([np.bincount(words.data[a:b], minlength=256) for a, b in zip(words.offsets[:-1], words.offsets[1:])]) if n else np.zeros((0, 256))
    out = [(counts @ table.T) / np.maximum(size, 1)[:, None]]
    of, many = words.text_of, np.maximum(np.diff(words.first), 1)
    length = (words.end - words.start).astype(float)
    three, at = windows(words.hashes[0], words.first, 3)
    lines = Words(texts, space=np.arange(256) == 10)
    first = words.data[words.start] if len(words) else np.zeros(0, np.uint8)
    last = words.data[words.end - 1] if len(words) else first
    out += [
        np.log1p(size),
        np.log1p(np.diff(words.first)),
        np.log1p(per_text(length, of, n) / many),
        per_text(length > 15, of, n) / many,
        share_distinct(words.hashes[0], of, n),
        share_distinct(three, of[at], n),
        np.log1p(np.diff(lines.first)),
        share_distinct(lines.hashes[0], lines.text_of, n),
        per_text((first >= 65) & (first <= 90), of, n) / many,
        per_text((last == 46) | (last == 33) | (last == 63), of, n) / many,
    ]
    return np.concatenate([x if x.ndim == 2 else x[:, None] for x in out], axis=1)


def document_statistics(docs: DataFrame, key: str, text: str, carry=()) -> DataFrame:
    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                found = statistics(rows.column(text))
                columns = {c: rows.column(c) for c in (key, *carry)} | {c: pa.array(found[:, k].astype(np.float32)) for k, c in enumerate(COLUMNS)}
                yield pa.RecordBatch.from_pydict(columns)
            give_back()

    kinds = f"{kept_columns(docs, key, carry)}, " + ", ".join(f"{c} float" for c in COLUMNS)
    return in_small_batches(docs).select(*dict.fromkeys((key, text, *carry))).mapInArrow(make, kinds)


def kept_columns(df: DataFrame, key: str, carry) -> str:
    """Schema of the key and the carried columns."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))


class Fourier:
    """Standardised statistics to cosines of random projections, and a constant."""

    def __init__(self, mean, deviation, size: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean, float), 1 / np.maximum(np.asarray(deviation, float), 1e-4)
        self.turn = rng.normal(0, 1 / width, (len(self.mean), size))
        self.shift = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        return np.c_[np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), z, np.ones(len(z))]


def matrix(rows) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS], axis=1).astype(float)


def normal_equations(train: DataFrame, fourier: Fourier, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both halves: the sums of z z' and z y, each partition's summed before they leave it."""

    def sums(batches):
        total = {}
        for batch in batches:
            z, y = fourier(matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                a, b = total.get(h, (0.0, 0.0))
                total[h] = a + z[half == h].T @ z[half == h], b + z[half == h].T @ y[half == h]
        for h, (a, b) in total.items():
            yield pa.RecordBatch.from_pydict({"half": pa.array([h], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()]})

    n = len(fourier.shift) + len(fourier.mean) + 1
    out = [(np.zeros((n, n)), np.zeros(n)) for _ in range(2)]
    for row in train.repartition(parts).mapInArrow(sums, "half int, a binary, b binary").toLocalIterator():
        out[row.half][0][:] += np.frombuffer(row.a).reshape(n, n)
        out[row.half][1][:] += np.frombuffer(row.b)
    return out


def ridge(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(a + penalty * np.eye(len(b)), b)


def pooled(rows: list[list[float]]) -> list[list[float]]:
    """Adjacent violators pooled: rows of (sum of scores, their number, good, cases) whose share of good cases rises."""
    out: list[list[float]] = []
    for row in rows:
        out.append(list(row))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [x + y for x, y in zip(out[-1], last)]
    return out


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the pools and their shares, which rise.

    Pools are smoothed by half a case each way. That moves small ones more than large ones, so they are pooled once more.
    """
    order = np.argsort(score)
    pools = pooled([[s * m, m, g, m] for s, g, m in zip(score[order], good[order], n[order])])
    sums = np.array(pooled([[s, m, g + 0.5, c + 1] for s, m, g, c in pools]))
    return sums[:, 0] / sums[:, 1], sums[:, 2] / sums[:, 3]


def quality_scores(
    docs: DataFrame, labels: DataFrame, trainable, key: str = "doc_id", text: str = "text", label: str = "quality",
    features: int = 256, width: float = 5.0, penalty: float = 1.0, most_rows: int = 200_000, parts: int = 16, carry=(),
) -> DataFrame:
    """``key, score`` for each row, with the columns ``carry`` between them: the probability that its label is 1.

    Learns from at most about ``most_rows`` labelled rows that ``trainable`` (a column expression on the
    key) admits, chosen by a hash of the key; statistics and scores cover all rows and whole texts. Null
    texts count as empty and are scored like them; null keys are scored but never learnt from; labels that
    are null are left out. A key is learnt from once, whatever its rows and labels: from one of its rows, with the mean of its
    labels. Repeated rows get equal scores. Without a single label everything scores 0.5. An empty table gives no rows; other columns are not read.
    """
    stats = written(document_statistics(docs, key, text, carry), "statistics")
    marks = labels.where(trainable & F.col(label).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("label"))
    total = marks.count()
    if total > most_rows:
        marks = marks.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * most_rows / total))
    once = stats.join(marks, key).groupBy(key).agg(F.min(F.struct(*COLUMNS)).alias("s"), F.first("label").alias("label"))
    train = written(once.select(key, "s.*", "label").withColumn("half", F.pmod(F.xxhash64(key), F.lit(2)).cast("int")), "training")
    moments = train.agg(*(F.avg(c) for c in COLUMNS), *(F.stddev_pop(c) for c in COLUMNS)).first()
    if moments[0] is None:
        return stats.select(key, *carry, F.lit(0.5).alias("score"))
    fourier = Fourier(moments[: len(COLUMNS)], moments[len(COLUMNS) :], features, width)
    halves = normal_equations(train, fourier, parts)
    other = [ridge(*halves[1 - h], penalty) for h in (0, 1)]
    whole = ridge(halves[0][0] + halves[1][0], halves[0][1] + halves[1][1], penalty)

    def crossed(batches):
        for batch in batches:
            z, half = fourier(matrix(batch)), batch.column("half").to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, z @ other[0], z @ other[1])
            yield pa.RecordBatch.from_pydict({"raw": pa.array(np.clip(raw, -1, 2)), "label": batch.column("label")})

    bins = train.mapInArrow(crossed, "raw double, label double").groupBy(F.floor(F.col("raw") * 512).alias("bin"))
    rows = bins.agg(F.avg("raw"), F.sum("label"), F.count("*")).collect()  # at most 1537
    knots, shares = isotonic(*np.array([r[1:] for r in rows], float).T)

    def scored(batches):
        for batch in batches:
            raw = np.clip(fourier(matrix(batch)) @ whole, -1, 2)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (key, *carry)} | {"score": pa.array(np.interp(raw, knots, shares))})

    return stats.mapInArrow(scored, f"{kept_columns(stats, key, carry)}, score double")
