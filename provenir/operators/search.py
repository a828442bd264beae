"""Random search over the families of classifiers that Spark has, by macro F1 on a dev set."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is drawn for each family: its settings and the values they may have.
FAMILIES = {
    "lr": (LogisticRegression, {"regParam": (0.0, 0.001, 0.01, 0.1), "elasticNetParam": (0.0, 0.5, 1.0)}),
    "svm": (LinearSVC, {"regParam": (0.001, 0.01, 0.1, 1.0)}),
    "dt": (DecisionTreeClassifier, {"maxDepth": (3, 5, 8), "minInstancesPerNode": (1, 5, 20)}),
    "rf": (RandomForestClassifier, {"numTrees": (20, 50), "maxDepth": (4, 6, 8)}),
    "gb": (GBTClassifier, {"maxIter": (10, 20), "maxDepth": (3, 5)}),
    "mlp": (MultilayerPerceptronClassifier, {"layers": ((16,), (32,), (32, 16))}),
}


def macro_f1(predicted: DataFrame) -> float:
    """Mean F1 of the classes of label (0 and 1) under prediction; a class that is neither there nor predicted counts 0."""
    hit = lambda c: F.count_if((F.col("label") == c) & (F.col("prediction") == c))
    r = predicted.agg(*(x.alias(f"{n}{c}") for c in (0, 1) for n, x in (("h", hit(c)), ("p", F.count_if(F.col("prediction") == c)), ("t", F.count_if(F.col("label") == c))))).first()
    return sum(2 * r[f"h{c}"] / max(1, r[f"p{c}"] + r[f"t{c}"]) for c in (0, 1)) / 2


def draws(family: str, count: int, seed: int) -> list[dict]:
    """So many different settings of a family, or all where there are fewer, in a seeded order."""
    _, space = FAMILIES[family]
    every = [{}]
    for name, values in space.items():
        every = [{**e, name: v} for e in every for v in values]
    random.Random(f"{seed}:{family}").shuffle(every)
    return every[:count]


def random_search(train: DataFrame, dev: DataFrame, features: list[str], families: list[str], count: int, seed: int = 1) -> tuple[list[dict], PipelineModel | None]:
    """Every drawn setting with its macro F1 on dev, best first (the earlier family of equals), and the best one's model.

    train and dev have the features and label (0 or 1). Features are brought to one scale by train's figures. The loop is
    over settings, a few; each fit runs on the cluster.
    """
    found: list[tuple] = []
    prepare = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(train)
    ready = prepare.transform(train).select("label", "features").cache()
    held = prepare.transform(dev).select("label", "features").cache()
    try:
        if ready.select("label").distinct().count() < 2:
            return [], None
        for family in families:
            kind, _ = FAMILIES[family]
            for setting in draws(family, count, seed):
                given = {k: [len(features), *v, 2] if k == "layers" else v for k, v in setting.items()}
                model = kind(labelCol="label", featuresCol="features", **given, **({"seed": seed} if "seed" in {p.name for p in kind().params} else {})).fit(ready)
                found.append((macro_f1(model.transform(held)), family, setting, model))
    finally:
        ready.unpersist()
        held.unpersist()
    found.sort(key=lambda x: -x[0])
    rows = [{"family": f, "setting": ", ".join(f"{k}={v}" for k, v in s.items()), "f1_macro": score, "place": i} for i, (score, f, s, _) in enumerate(found, 1)]
    return rows, PipelineModel(stages=[*prepare.stages, found[0][3]]) if found else None
