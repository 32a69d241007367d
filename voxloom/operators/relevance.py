"""The relevance classifier: training, folds, evaluation, resampling."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import number_rows
from voxloom.operators.glossary import count_vector, position_vector, relevant_count
from voxloom.operators.scoring import knowledge_kind, score_with_fitted
from voxloom.session import stored

HASHES = 1 << 14
MLP_HASHES = 512
POSITIONS = 120


def with_knowledge(
    df: DataFrame, glossary: DataFrame | None, knowledge: str = "None", text: str = "Review"
) -> DataFrame:
    """Add ``knowledge``, the glossary vector of kind RC or RP; nothing for None."""
    kind = knowledge_kind(knowledge)
    if kind == "None":
        return df
    if kind == "RC":
        counted = relevant_count(df, glossary, text)
        return count_vector(counted, 1, out="knowledge").drop("rc")
    return position_vector(df, glossary, POSITIONS, text, out="knowledge")


def classifier(
    knowledge: str = "None", mlp: bool = False, hashes: int = HASHES, mlp_hashes: int = MLP_HASHES
) -> Pipeline:
    """Hashed TF-IDF words, plus the glossary vector, under a logistic head.

    ``mlp`` puts two hidden layers under the output; its input layer has
    ``mlp_hashes`` hash slots, the linear head has ``hashes``.
    """
    kind = knowledge_kind(knowledge)
    width = mlp_hashes if mlp else hashes
    inputs = ["_tfidf"] + ([] if kind == "None" else ["knowledge"])
    extra = {"None": 0, "RC": 1, "RP": POSITIONS}[kind]
    if mlp:
        head = MultilayerPerceptronClassifier(
            layers=[width + extra, 64, 32, 2], seed=42, maxIter=50, featuresCol="_all",
            labelCol="Relevant",
        )
    else:
        head = LogisticRegression(maxIter=20, regParam=0.01, featuresCol="_all", labelCol="Relevant")
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="Review", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            VectorAssembler(inputCols=inputs, outputCol="_all"),
            head,
        ]
    )


def train(
    labelled: DataFrame, glossary: DataFrame | None = None, knowledge: str = "None", mlp: bool = False
) -> PipelineModel:
    # The fit reads its rows for the weights of the words and again for the head.
    known = with_knowledge(labelled, glossary, knowledge)
    return classifier(knowledge, mlp).fit(known if knowledge_kind(knowledge) == "None" else stored(known))


def predict(
    model: PipelineModel, df: DataFrame, glossary: DataFrame | None = None, knowledge: str = "None"
) -> DataFrame:
    """Scores and predictions of a fitted classifier, the input columns kept."""
    scored = score_with_fitted(with_knowledge(df, glossary, knowledge), model)
    return scored.drop("knowledge")


def with_folds(df: DataFrame, n: int = 5, seed: int = 123, key: str = "review_id") -> DataFrame:
    """Add ``fold`` 0..n-1: shuffled by a seeded hash, sizes differ by one at most."""
    shuffled = df.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    ranked = number_rows(
        shuffled, ["_h", key], {"slice": F.shiftright("_h", 48)}, out="_rank"
    )
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % n).cast("int")).drop("_h", "_rank")


def confusion(df: DataFrame, label: str = "Relevant", prediction: str = "binary_prediction",
              by: list[str] | None = None) -> DataFrame:
    """Counts of true and false positives and negatives, one row (per group)."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; null on zero division."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def average_metrics(metrics: DataFrame) -> DataFrame:
    names = ["accuracy", "precision", "recall", "f1"]
    return metrics.agg(*[F.avg(n).alias(n) for n in names])


def cross_validate(
    labelled: DataFrame,
    n_folds: int = 5,
    run_folds: int | None = None,
    glossary: DataFrame | None = None,
    knowledge: str = "None",
    mlp: bool = False,
    seed: int = 123,
) -> DataFrame:
    """Metrics per fold: train on the other folds, test on this one."""
    folded = with_folds(with_knowledge(labelled, glossary, knowledge), n_folds, seed).persist()
    parts = []
    for fold in range(run_folds or n_folds):
        model = classifier(knowledge, mlp).fit(folded.where(F.col("fold") != fold))
        tested = score_with_fitted(folded.where(F.col("fold") == fold), model)
        parts.append(classification_metrics(confusion(tested, by=["fold"])))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stratified_split(
    df: DataFrame, share: float = 0.7, seed: int = 42, label: str = "Relevant", key: str = "review_id"
) -> DataFrame:
    """Add ``train``: an exact share of each label, chosen by a seeded hash."""
    shuffled = df.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    ranked = number_rows(
        shuffled, ["_h", key], {"slice": F.shiftright("_h", 48)}, within=[label], out="_rank"
    )
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col("_rank") <= F.round(F.col("_n") * share)
    return ranked.join(sizes, label).withColumn("train", keep).drop("_h", "_rank", "_n")


def balanced_sample(
    df: DataFrame, seed: int = 42, label: str = "Relevant", minority_share: float = 1.0
) -> DataFrame:
    """Both labels drawn with replacement to about the size of the smaller one."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    small = min(sizes.values()) * minority_share
    parts = [df.where(F.col(label) == v).sample(True, small / n, seed) for v, n in sizes.items()]
    return parts[0].unionByName(parts[1])


def not_sampled(df: DataFrame, sample: DataFrame, key: str = "review_id") -> DataFrame:
    """The rows a sample left out, as test data."""
    return df.join(sample.select(key).distinct(), key, "left_anti")
