"""Quality scores from a sparse rule ensemble, compiled into column expressions.

A forest of shallow trees is grown on statistics of the labelled texts. Every path from a root is a rule: a conjunction of
comparisons. A logistic model with lasso penalty weighs the rules and the statistics, and
the few it keeps become one native expression over the statistics of a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import held_out, stored

THRESHOLD = 0.7
TREES = 24
TREE_DEPTH = 3
SEED = 7
# Lasso penalties tried; the best on a quarter of the rows learned from is kept.
PENALTIES = (0.001, 0.005)
LASSO_STEPS = 60
# Statistics enter the linear part between these quantiles of the labelled rows.
CLIP = (0.025, 0.975)

_SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text; a null text counts as empty.

    Ratios are of the characters, words or lines; an empty text has 0 everywhere.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text).cast("double")
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_words = F.size(words).cast("double")
    n_lines = F.size(lines).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(n_words),
        "word_length": ratio(chars, n_words),
        "words_a_line": ratio(n_words, n_lines),
        "log_lines": F.log1p(n_lines),
        "upper": ratio(count(r"\p{Lu}"), chars),
        "digits": ratio(count(r"\p{Nd}"), chars),
        "symbols": ratio(count(r"[^\p{L}\p{N}\s.,;:'\"()-]"), chars),
        "stops": ratio(count(r"[.!?](?=\s|$)"), n_words),
        "commas": ratio(count(r"[,;:]"), n_words),
        "lone_symbols": ratio(count(r"(?<=\s)[^\p{L}\p{N}\s]+(?=\s)"), n_words),
        "symbol_ends": ratio(count(r"[^\p{L}\p{N}\s.,;:'\")][^\p{L}\p{N}\s]*(?=\s|$)"), n_words),
        "shouted": ratio(count(r"\p{Lu}{2,}"), n_words),
        "distinct_words": ratio(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)).cast("double"), n_lines),
    }


NAMES = tuple("log_chars log_words word_length words_a_line log_lines upper digits symbols stops commas "
              "lone_symbols symbol_ends shouted distinct_words distinct_lines".split())

Condition = tuple[int, bool, float]  # statistic, above?, bound


@dataclass(frozen=True)
class RuleModel:
    """Weights of rules and of clipped statistics; ``intercept`` alone when nothing was learned."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...] = ()
    linear: tuple[tuple[int, float, float, float], ...] = ()  # statistic, low, high, weight

    def score(self) -> Column:
        """Probability of label 1 as an expression over columns named as in ``NAMES``."""
        parts = [F.lit(self.intercept)]
        parts += [F.when(rule_column(r), F.lit(w)).otherwise(0.0) for r, w in self.rules]
        parts += [clipped(i, low, high) * F.lit(w) for i, low, high, w in self.linear]
        total = reduce(lambda a, b: a + b, parts)
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, weightiest first."""
        ranked = sorted(self.rules, key=lambda r: -abs(r[1]))
        return [
            f"{w:+.3f} if " + " and ".join(f"{NAMES[i]} {'>' if up else '<='} {b:.4g}" for i, up, b in r)
            for r, w in ranked
        ]


def rule_column(rule: tuple[Condition, ...]) -> Column:
    tests = [F.col(NAMES[i]) > b if up else F.col(NAMES[i]) <= b for i, up, b in rule]
    return reduce(lambda a, b: a & b, tests)


def clipped(statistic: int, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(NAMES[statistic]), F.lit(low)), F.lit(high))


def tree_paths(debug: str) -> set[tuple[Condition, ...]]:
    """Paths from the root to every other node of a printed tree, as sorted conditions.

    Of two bounds in the same direction on one statistic the tighter one stays.
    """
    found, path = set(), []
    for line in debug.splitlines():
        test = re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee+]+)\)", line)
        if not test:
            continue
        depth = len(line) - len(line.lstrip())
        path = [p for p in path if p[0] < depth]
        path.append((depth, (int(test[2]), test[3] == ">", float(test[4]))))
        tightest: dict[tuple[int, bool], float] = {}
        for _, (i, up, bound) in path:
            known = tightest.get((i, up), bound)
            tightest[i, up] = max(known, bound) if up else min(known, bound)
        found.add(tuple(sorted((i, up, b) for (i, up), b in tightest.items())))
    return found


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and statistics of every document, stored, so that texts are read once for both uses."""
    numbers = statistics(F.col(f"`{text_col}`"))
    return stored(docs.select(id_col, *[numbers[n].alias(n) for n in NAMES]), "statistics")


def fit(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    label_id_col: str = "doc_id",
) -> RuleModel:
    """Learn a rule model from the labelled documents whose id is not held out.

    Only labels 0 and 1 count. A document labelled more than once, or there more than once, counts as
    often. Without rows of both labels the score is the share of label 1, or a half without any.
    """
    wanted = labels.select(
        F.col(label_id_col).alias(id_col), F.col(label_col).cast("double").alias("_label")
    ).where(F.col("_label").isin(0.0, 1.0) & ~held_out(id_col))
    rows = stored(
        stats.join(wanted, id_col).withColumn(
            "_check", F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 3
        ),
        "labelled",
    )
    share = rows.agg(F.avg("_label").alias("share")).first()["share"]
    if share is None or share in (0.0, 1.0):
        rate = 0.5 if share is None else min(max(share, 0.01), 0.99)
        return RuleModel(float(_logit(rate)))
    base = VectorAssembler(inputCols=list(NAMES), outputCol="_x").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="_x",
        labelCol="_label",
        numTrees=TREES,
        maxDepth=TREE_DEPTH,
        featureSubsetStrategy="onethird",
        minInstancesPerNode=5,
        seed=SEED,
    ).fit(base.select("_x", "_label"))
    rules = sorted(set().union(*(tree_paths(t.toDebugString) for t in forest.trees)))
    bounds = rows.approxQuantile(list(NAMES), list(CLIP), 0.001)
    terms = [rule_column(r).cast("double") for r in rules]
    terms += [clipped(i, low, high) for i, (low, high) in enumerate(bounds)]
    names = [f"_t{i}" for i in range(len(terms))]
    design = VectorAssembler(inputCols=names, outputCol="_terms").transform(
        rows.select("_label", "_check", *[t.alias(n) for t, n in zip(terms, names)])
    )
    design = design.select("_label", "_check", "_terms").persist()

    def weigh(penalty: float, part: DataFrame) -> RuleModel:
        fitted = _lasso(penalty).fit(part)
        weights = fitted.coefficients.toArray().tolist()
        kept = [(r, w) for r, w in zip(rules, weights) if w]
        linear = [(i, *bounds[i], w) for i, w in enumerate(weights[len(rules) :]) if w]
        return RuleModel(float(fitted.intercept), tuple(kept), tuple(linear))

    model = weigh(_best_penalty(design, rows, weigh), design)
    design.unpersist()
    return model


def _logit(rate: float) -> float:
    return log(rate / (1 - rate))


def _lasso(penalty: float) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_terms",
        labelCol="_label",
        elasticNetParam=1.0,
        regParam=penalty,
        maxIter=LASSO_STEPS,
    )


def _best_penalty(
    design: DataFrame, rows: DataFrame, weigh: Callable[[float, DataFrame], RuleModel]
) -> float:
    """The penalty with the smallest log loss on the rows set aside; the largest if there are too few."""
    labels = design.groupBy("_check").agg(F.countDistinct("_label").alias("n"))
    kinds = {r["_check"]: r["n"] for r in labels.collect()}
    if kinds.get(True) != 2 or kinds.get(False) != 2:
        return PENALTIES[-1]
    losses = {}
    for penalty in PENALTIES:
        chance = weigh(penalty, design.where(~F.col("_check"))).score()
        right = F.when(F.col("_label") == 1, chance).otherwise(1 - chance)
        loss = -F.avg(F.log(F.greatest(right, F.lit(1e-9))))
        losses[penalty] = rows.where("_check").agg(loss.alias("loss")).first()["loss"]
    return min(losses, key=losses.__getitem__)


def score(stats: DataFrame, model: RuleModel, id_col: str = "doc_id") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` (1 from the threshold on) of every document.

    Null and empty texts are scored from their zero statistics; rows with a null id are scored too
    (``held_out`` is null for them).
    """
    return stats.select(
        id_col, held_out(id_col).alias("held_out"), model.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
