"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Statistics of each whole text are columns. A random forest is grown on the
labelled rows; every path from a root to a node is a conjunctive rule over the
statistics. A lasso logistic regression weighs the rules, most of them to zero,
and the rest are compiled into one Spark column expression: scoring runs
without Python. Fitting is distributed (Spark ML) over all labelled rows.

Defined cases: null and empty texts have zero statistics and get a score like
any other; with no labelled rows, labels of one class only, or statistics that
tell no two labelled texts apart, the score is the share of label 1 (0.5
without rows) for every text; null labels are left out; of several labels of a
doc_id the highest counts; repeated rows are scored alike; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgauge.llm.common import written

TREES, DEPTH, LASSO, SEED = 24, 3, 5e-4, 7
#: The score from which a text counts as good.
CUT = 0.3

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text, all numbers."""
    t = F.coalesce(text, F.lit(""))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = F.length(t)
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return {
        "chars": n.cast("double"),
        "words": F.size(words).cast("double"),
        "lines": F.size(lines).cast("double"),
        "word_length": per(n, F.size(words)),
        "line_length": per(n, F.size(lines)),
        "letters": per(letters, n),
        "capitals": per(F.regexp_count(t, F.lit(r"\p{Lu}")), letters),
        "digits": per(F.regexp_count(t, F.lit(r"\p{N}")), n),
        "symbols": per(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:'\"?!()-]")), n),
        "stops": per(n - F.length(F.translate(t, ".?!", "")), F.size(words)),
        "exclamations": per(n - F.length(F.translate(t, "!", "")), F.size(words)),
        "distinct_words": per(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the statistics, written once: these narrow rows serve fitting and scoring."""
    return written(docs.select("doc_id", *[c.alias(k) for k, c in statistics(F.col("text")).items()]))


def rules_of(tree: str, names: list[str]) -> list[Rule]:
    """Every path from the root of a printed decision tree to a node below it, as a conjunction."""
    found, path = [], []
    for line in tree.split("\n"):
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)", line)
        if m:
            del path[(len(m[1]) - FIRST_INDENT) :]
            path.append((names[int(m[2])], m[3], float(m[4])))
            found.append(tuple(path))
    return found


#: Blanks before the first level of a printed tree; each level adds one.
FIRST_INDENT = 2


def simplified(rule: Rule) -> Rule:
    """One bound a side of each statistic, in a fixed order."""
    best: dict[tuple[str, str], float] = {}
    for name, op, x in rule:
        old = best.get((name, op), x)
        best[(name, op)] = min(old, x) if op == "<=" else max(old, x)
    return tuple((n, o, x) for (n, o), x in sorted(best.items()))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, x in rule:
        out = out & (F.col(name) <= x if op == "<=" else F.col(name) > x)
    return out


class RuleEnsemble:
    def __init__(self, intercept: float, weights: list[tuple[float, Rule]]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        z = F.lit(float(self.intercept))
        for w, rule in self.weights:
            z = z + F.when(condition(rule), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.round(1 / (1 + F.exp(-z)), 9)


def fit(labelled: DataFrame) -> RuleEnsemble:
    """labelled(statistics, label 0/1) -> the ensemble."""
    names = [c for c in labelled.columns if c != "label"]
    data = labelled.select(array_to_vector(F.array(*names)).alias("features"), F.col("label").cast("double"), *names)
    n, good = data.agg(F.count("*"), F.sum("label")).first()
    p = min(max((good or 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
    constant = RuleEnsemble(math.log(p / (1 - p)), [])
    if not n or good in (0, n):
        return constant
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, maxBins=64).fit(data)
    rules = sorted({simplified(r) for t in forest.trees for r in rules_of(t.toDebugString, names)})
    if not rules:
        return constant
    # label 0 is the rare one: both classes weigh alike in the loss would move the cut, so rows keep weight 1
    by_rule = data.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(by_rule)
    return RuleEnsemble(lasso.intercept, [(w, r) for w, r in zip(lasso.coefficients.toArray().tolist(), rules, strict=True) if w])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that aren't held out and scores every row: doc_id, held_out, score, predicted."""
    stats = measured(docs)
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit(stats.where(~held_out()).join(marks, "doc_id").drop("doc_id"))
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
