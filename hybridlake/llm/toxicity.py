"""Toxicity (operator 10): a classifier chain of linear models.

Categories are predicted one after another. Each link is a logistic regression
over the texts' telling words and word beginnings and over the probabilities of
the categories before it. A link learns from out-of-fold probabilities of the
earlier ones, as uncertain as those of texts that no model has seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridlake.llm.common import keyed, stored, texts
from hybridlake.llm.quality_model import held_out

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityParams:
    #: Labelled rows that a fit uses at most, about (a sample by hash above it).
    max_fit_rows: int = 30_000
    #: Words and beginnings that the links see.
    features: int = 384
    folds: int = 2
    ridge: float = 1e-4
    iterations: int = 12
    threshold: float = 0.5
    #: Categories before the last, and the labelled rows that one needs.
    max_categories: int = 8
    min_category_rows: int = 20


def features(text: str) -> Counter:
    """How often each word and each word beginning (marked by a hyphen) occurs."""
    words = Counter(LETTERS.findall(text.lower()))
    found = Counter(words)
    for n in BEGINNINGS:
        for word, times in words.items():
            if len(word) > n:
                found[word[:n] + "-"] += times
    return found


def counts_at(text: str, place: dict[str, int]) -> dict[int, int]:
    """The occurrences of the features in ``place``, by their number there."""
    found: dict[int, int] = {}
    for word, times in Counter(LETTERS.findall(text.lower())).items():
        at = place.get(word)
        if at is not None:
            found[at] = found.get(at, 0) + times
        for n in BEGINNINGS:
            if len(word) <= n:
                break
            at = place.get(word[:n] + "-")
            if at is not None:
                found[at] = found.get(at, 0) + times
    return found


def dense(rows: list[dict[int, int]], size: int):
    """A row per text, a column per feature: the logarithm of its occurrences."""
    import numpy as np

    x = np.zeros((len(rows), size), np.float32)
    for row, found in zip(x, rows):
        if found:
            row[list(found)] = np.log1p(list(found.values()))
    return x


def with_link(x, weights):
    """``x`` and the probability that a link gives each of its rows, as a further column."""
    import numpy as np

    margin = x @ np.array(weights[:-1], np.float32) + weights[-1]
    return np.column_stack([x, 1 / (1 + np.exp(-np.clip(margin, -50, 50)))]).astype(np.float32)


def logistic(x, y, ridge: float, iterations: int) -> list[float]:
    """Weights and intercept of a ridge logistic regression, by Newton steps."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)))
    penalty[-1] = 1e-6
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(curve.astype(np.float64) + np.diag(penalty), slope)
        w -= step * min(1.0, 8 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w.tolist()


@dataclass
class ToxicityModel:
    params: ToxicityParams
    place: dict[str, int] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    #: Of each link: weights of the features, then of the earlier probabilities, then the intercept.
    links: list[list[float]] = field(default_factory=list)

    def probabilities(self, block: list[str]):
        """A row per text, a column per category."""
        x = dense([counts_at(t, self.place) for t in block], len(self.place))
        for weights in self.links:
            x = with_link(x, weights)
        return x[:, len(self.place):].astype(float)


def _telling(labelled: DataFrame, categories: list[str], params: ToxicityParams) -> list[str]:
    """The features whose share among a category's rows differs most from the rest, in standard errors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(features(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)],
                                             names=["found", "y"])

    rows = labelled.select("text", "y").mapInArrow(run, "found array<string>, y array<double>")
    total = labelled.agg(F.count(F.lit(1)).alias("n"), *(
        F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(len(categories)))).first()
    counts = rows.select(F.explode("found").alias("feature"), "y").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(len(categories))))
    scores = []
    for i in range(len(categories)):
        share = (total[f"y{i}"] or 0.0) / total["n"]
        expected = F.col("n") * share
        scores.append((F.col(f"y{i}") - expected) / F.sqrt(expected * (1 - share) + 1))
    each = max(1, params.features // len(categories))
    # params.features rows at most
    best = [r["feature"] for score in scores for r in counts.where("n >= 3").orderBy(
        score.desc(), "feature").limit(each).select("feature").collect()]
    return list(dict.fromkeys(best))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], params: ToxicityParams = ToxicityParams(),
        id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A chain over the 0/1 columns ``categories`` of ``labels``, in that order.

    Rows with a null id or label take no part, nor do those that ``held_out``
    names. Without labelled rows the model has no links.
    """
    whole = F.lit(True)
    for c in categories:
        whole = whole & F.col(c).isNotNull()
    usable = labels.where(F.col(id_col).isNotNull() & whole & ~held_out(id_col)).select(
        F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in categories]).alias("y"))
    n = usable.count()
    if n > params.max_fit_rows:
        share = int(params.max_fit_rows / n * 1_000_000)
        usable = usable.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share)
    usable = usable.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(params.folds)).cast("int"))
    model = ToxicityModel(params, categories=list(categories))
    # bounded by max_fit_rows rows of a few numbers
    labelled = stored(keyed(docs, id_col, text_col).join(F.broadcast(usable), F.col("doc_id") == F.col("_id"))
                      .select("text", "y", "fold"), "toxicity-labelled")
    if not n or labelled.isEmpty():
        return ToxicityModel(params)
    model.place = {f: i for i, f in enumerate(_telling(labelled, categories, params))}
    size, place = len(model.place), model.place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_at(t, place) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(f.items()) for f in found], pa.map_(pa.int32(), pa.int32())), batch.column(1),
                 batch.column(2)], names=["x", "y", "fold"])

    table = stored(labelled.mapInArrow(run, "x map<int,int>, y array<double>, fold int"), "toxicity-features")
    folds = params.folds
    # a link's models, one per task: without fold 0, without fold 1, ..., of all; max_fit_rows rows each at most
    learners = table.withColumn("without", F.explode(F.array(*[F.lit(f) for f in range(folds + 1)]))).where(
        "fold <> without")
    of_fold: list[list[list[float]]] = []  # by link, then by the fold left out

    for i in range(len(categories)):
        link, earlier = i, list(of_fold)

        def learn(group: pa.Table) -> pa.Table:
            import numpy as np

            x = dense([dict(r) for r in group.column("x").to_pylist()], size)
            fold = group.column("fold").to_numpy()
            for weights in earlier:  # each row's from the model that has not seen it
                column = np.zeros(len(x), np.float32)
                for f in range(folds):
                    column[fold == f] = with_link(x[fold == f], weights[f])[:, -1]
                x = np.column_stack([x, column])
            y = np.array([r[link] for r in group.column("y").to_pylist()])
            found = logistic(x, y, params.ridge, params.iterations)
            return pa.table({"without": [group.column("without")[0].as_py()], "weights": [found]},
                            schema=pa.schema([("without", pa.int32()), ("weights", pa.list_(pa.float64()))]))

        found = {r["without"]: list(r["weights"]) for r in learners.groupBy("without").applyInArrow(
            learn, "without int, weights array<double>").collect()}
        of_fold.append([found.get(f, found[folds]) for f in range(folds)])
        model.links.append(found[folds])
    return model


def probabilities(text: Column, model: ToxicityModel) -> Column:
    """The categories' probabilities for a text column, in the chain's order."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def chain(values: pd.Series) -> pd.Series:
        block = values.tolist()
        found = [row for at in range(0, len(block), 1_000)
                 for row in model.probabilities([v or "" for v in block[at:at + 1_000]]).tolist()]
        return pd.Series(found, dtype=object)

    return chain(F.coalesce(text, F.lit("")))


def by_language(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> tuple[DataFrame, list[str]]:
    """Labels with a category for toxic texts of each common language, then ``toxic`` itself."""
    known = labels.select("doc_id", "toxic").join(docs.select("doc_id", "lang"), "doc_id").where(
        "toxic is not null and lang is not null")
    common = known.where("toxic = 1").groupBy("lang").count().where(F.col("count") >= params.min_category_rows).orderBy(
        F.col("count").desc(), "lang").limit(params.max_categories).collect()
    names = {f"toxic_{r['lang']}": r["lang"] for r in common}
    columns = {name: ((F.col("toxic") == 1) & (F.col("lang") == lang)).cast("int") for name, lang in names.items()}
    return known.withColumns(columns), [*names, "toxic"]


def classify(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``doc_id, held_out, score, predicted, categories`` of every row of ``docs(doc_id, text, lang)``.

    ``score`` is the probability of ``toxic``, the chain's last link. A null or
    empty text has no features and gets the links' intercepts. Without labels
    the score is 0. Repeated rows each get their row.
    """
    labelled, names = by_language(docs, labels, params)
    model = fit(docs, labelled, names, params)
    if not model.links:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"),
                           F.lit(0).alias("predicted"), F.lit("").alias("categories"))
    found = keyed(docs, "doc_id", "text").select("doc_id", probabilities(F.col("text"), model).alias("_p"))
    shown = F.concat_ws(",", *[F.concat(F.lit(f"{name}:"), F.format_number(F.col("_p")[i], 4))
                               for i, name in enumerate(names)])
    score = F.element_at("_p", -1)
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score"),
                        (score >= params.threshold).cast("int").alias("predicted"), shown.alias("categories"))
