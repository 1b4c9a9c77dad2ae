"""Quality classifier (operator 3): random Fourier features, ridge, isotonic calibration.

Statistics of each text are mapped to random Fourier features, whose inner
products approximate a Gaussian kernel. Every partition of the labelled rows
sums its part of the normal equations; their sum gives the ridge weights. The
rows of one half are scored by weights of the other, and isotonic regression
over those scores turns a score into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import keyed, raw_texts, stored


@dataclass(frozen=True)
class QualityParams:
    #: Labelled rows that a fit uses at most, about (a sample by hash above it).
    max_fit_rows: int = 200_000
    fourier_features: int = 256
    #: Kernel width, in units of the root of the number of statistics.
    width: float = 0.7
    ridge: float = 1e-3
    #: Score bins that the calibration sees.
    bins: int = 4_096
    seed: int = 20
    threshold: float = 0.3
    #: The summing tasks, each of which sends one matrix to the driver.
    parts: int = 12


STATISTICS = (
    "log_bytes", "log_words", "log_lines", "chars_per_word", "words_per_line", "distinct_words", "same_as_before",
    "top_word", "repeated_pairs", "repeated_lines", "symbols", "pipes", "exclamations", "capitals", "digits",
    "sentence_marks", "other_marks", "non_ascii", "byte_entropy", "capital_words", "marked_words", "long_words")

_SYMBOLS, _SENTENCE, _OTHER = b"#*$%&<>^~=+_", b".,;:?", b"\"'()[]{}/\\@-"


def statistics(text: bytes) -> list[float]:
    """The numbers of ``STATISTICS``; all zero for a text without words."""
    import numpy as np

    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    bytes_at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = bytes_at[bytes_at > 0] / len(text)
    count = lambda marks: float(bytes_at[list(marks)].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    capitals = count(range(65, 91))
    letters = max(1.0, capitals + count(range(97, 123)))
    words_of, pairs = Counter(words), set(zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(n), np.log1p(len(lines)), sum(map(len, words)) / n, n / len(lines),
        len(words_of) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(words_of.values()) / n,
        1 - len(pairs) / max(1, n - 1), 1 - len(set(lines)) / len(lines), count(_SYMBOLS) / n, bytes_at[124] / n,
        bytes_at[33] / n, capitals / letters, count(range(48, 58)) / len(text), count(_SENTENCE) / n,
        count(_OTHER) / n, float(bytes_at[128:].sum()) / len(text), float(-(share * np.log(share)).sum()),
        sum(w.isupper() for w in words) / n, sum(w[-1] in _SYMBOLS for w in words) / n,
        sum(len(w) > 16 for w in words) / n]


@dataclass
class QualityModel:
    params: QualityParams
    center: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    #: Calibration: probabilities at rising scores, straight lines between.
    scores: list[float] = field(default_factory=list)
    probabilities: list[float] = field(default_factory=list)

    def fourier(self, stats):
        import numpy as np

        rng = np.random.default_rng(self.params.seed)
        d, size = len(STATISTICS), self.params.fourier_features
        turn = rng.normal(size=(d, size)) / (self.params.width * np.sqrt(d))
        phase = rng.uniform(0, 2 * np.pi, size)
        x = np.clip((stats - np.array(self.center)) / np.array(self.scale), -4, 4)
        waves = np.sqrt(2 / size) * np.cos(x @ turn + phase)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)  # the last carries the mean

    def raw(self, stats, weights=None):
        import numpy as np

        return self.fourier(stats) @ np.array(self.weights if weights is None else weights)

    def probability(self, stats):
        import numpy as np

        if not self.weights or not len(stats):
            return np.full(len(stats), 0.5)  # nothing was learnt
        return np.clip(np.interp(self.raw(stats), self.scores, self.probabilities), 0, 1)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that no fit may see: CRC-32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _stats_table(labelled: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("half", T.IntegerType()),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, arrow.field(2).type)],
                                             schema=arrow)

    return labelled.select("y", "half", "text").mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch):
    return batch.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))


def _normal_equations(table: DataFrame, model: QualityModel):
    """Sums of z z' and z y of both halves, each partition's added up by the driver."""
    import numpy as np

    size = model.params.fourier_features + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size + 1))
        for batch in batches:
            z, y, half = model.fourier(_matrix(batch)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for h in (0, 1):
                own = z[half == h]
                total[h] += own.T @ np.column_stack([own, y[half == h]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = table.coalesce(model.params.parts).mapInArrow(run, "sums binary").collect()  # <= parts rows
    return sum(np.frombuffer(r["sums"]).reshape(2, size, size + 1) for r in parts)


def _solve(sums, ridge: float):
    import numpy as np

    gram, right = sums[:, :-1], sums[:, -1]
    n = max(1.0, gram[-1, -1])
    penalty = np.full(len(gram), ridge * n / len(gram))
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(gram + np.diag(penalty), right)


def isotonic(values: list[float], weights: list[float]) -> list[float]:
    """The nearest rising values, by pooling neighbours that fall."""
    pools: list[list[float]] = []  # [sum, weight, members]
    for value, weight in zip(values, weights):
        pools.append([value * weight, weight, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, weight_, members = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + weight_, pools[-1][2] + members]
    return [total / weight for total, weight, members in pools for _ in range(int(members))]


def _calibrate(table: DataFrame, model: QualityModel, other) -> tuple[list[float], list[float]]:
    """Isotonic regression over score bins; ``other[h]`` are the weights that half ``h`` had no part in."""
    bins = model.params.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x, half = _matrix(batch), batch.column(1).to_numpy()
            score = np.where(half == 0, model.raw(x, other[0]), model.raw(x, other[1]))
            at = np.clip(np.floor((score + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], names=["bin", "y"])

    counted = table.mapInArrow(run, "bin long, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # <= bins rows
    rising = isotonic([r["ones"] / r["n"] for r in counted], [r["n"] for r in counted])
    return [(r["bin"] + 0.5) / bins * 2 - 0.5 for r in counted], rising


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", params: QualityParams = QualityParams(),
        id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model of ``labels`` (id, 0/1), learnt from the rows that ``held_out`` leaves.

    Null labels and ids take no part; a repeated label counts as often as it
    stands there. Without any labelled row every text scores 0.5.
    """
    import numpy as np

    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    n = usable.count()
    if n > params.max_fit_rows:
        share = int(params.max_fit_rows / n * 1_000_000)
        usable = usable.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share)
    usable = usable.withColumn("half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int"))
    # bounded by max_fit_rows rows of 20 bytes
    labelled = keyed(docs, id_col, text_col).join(F.broadcast(usable), F.col("doc_id") == F.col("_id"))
    table = stored(_stats_table(labelled), "quality-statistics")
    size = len(STATISTICS)
    row = table.agg(F.count(F.lit(1)).alias("n"), *(
        f(F.col("x")[i]).alias(f"{name}{i}") for i in range(size)
        for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    model = QualityModel(params)
    if not row["n"]:
        return model
    model.center = [row[f"m{i}"] for i in range(size)]
    model.scale = [row[f"s{i}"] if row[f"s{i}"] > 1e-9 else 1.0 for i in range(size)]
    sums = _normal_equations(table, model)
    whole = _solve(sums[0] + sums[1], params.ridge)
    first, second = (_solve(sums[h], params.ridge) if sums[h][-1, -2] else whole for h in (0, 1))
    model.scores, model.probabilities = _calibrate(table, model, (second, first))
    model.weights = whole.tolist()
    assert np.isfinite(whole).all()
    return model


def score(text: Column, model: QualityModel) -> Column:
    """The probability of label 1 for a text column; null is the empty text."""

    @F.pandas_udf(T.DoubleType())
    def probability(values: pd.Series) -> pd.Series:
        import numpy as np

        stats = np.array([statistics((v or "").encode()) for v in values]).reshape(-1, len(STATISTICS))
        return pd.Series(model.probability(stats))

    return probability(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", params: QualityParams = QualityParams(),
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    A null or empty text has statistics of zero and is scored by them; a null
    id is never held out. Repeated rows each get their row.
    """
    model = fit(docs, labels, label_col, params, id_col, text_col)
    scored = keyed(docs, id_col, text_col).select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", params: QualityParams = QualityParams(),
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted to have label 1.

    Null texts are judged as empty ones and stay null; without any labelled row
    nothing goes.
    """
    model = fit(docs, labels, label_col, params, id_col, text_col)
    return docs.where(score(F.col(text_col), model) >= params.threshold)
