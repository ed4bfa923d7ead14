"""Attack-type identification with a random forest."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from . import forest as G, metrics as M

PREDICTED = "predicted_attack_type"


def category_indexers(train: DataFrame, test: DataFrame, columns) -> list:
    """Alphabetical codes per category column, fitted on both sides; unseen values are an error."""
    models = []
    for c in columns:
        universe = train.select(c).union(test.select(c)).distinct()
        indexer = StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc", handleInvalid="error")
        models.append(indexer.fit(universe))
    return models


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights; the table has one row per class."""
    return df.join(M.class_weights(df, label).select(label, "weight"), label)


def train_identifier(train: DataFrame, test: DataFrame, features, label="label", categorical=(), trees=150, depth=20,
                     min_leaf=3, seed=S.SEED) -> PipelineModel:
    """Forest over numeric and coded features with balanced class weights.

    ``test`` only widens the category codes and the label set; it is not trained on. Codes are
    plain numbers to the trees, as alphabetical ranks."""
    numeric = [c for c in features if c not in categorical]
    coders = category_indexers(train, test, categorical)
    codes = ", ".join(f"float({c}_index) AS {c}_code" for c in categorical)
    plain = [SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__")] if categorical else []
    labels = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error").fit(
        train.select(F.col(label).cast("string")).union(test.select(F.col(label).cast("string"))).distinct())
    assembler = VectorAssembler(inputCols=numeric + [f"{c}_code" for c in categorical], outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction", probabilityCol="_probability",
        rawPredictionCol="_raw", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        seed=seed, maxMemoryInMB=1024)
    prepared = with_class_weight(train, label)
    for step in coders + plain + [labels, assembler]:
        prepared = step.transform(prepared)
    prepared = prepared.select("_features", "_label", "weight").persist()
    fitted = G.fit(prepared, forest, len(labels.labels))
    prepared.unpersist()
    # Scoring needs no truth column: the label codes are turned back by name.
    back = IndexToString(inputCol="_prediction", outputCol=PREDICTED, labels=labels.labels)
    return PipelineModel(coders + plain + [assembler, fitted, back])


def score_events(model: PipelineModel, df: DataFrame, keep) -> DataFrame:
    """Predictions next to the light columns; everything wide is dropped right after scoring."""
    return model.transform(df).select(*keep, PREDICTED)


def importances(model: PipelineModel) -> DataFrame:
    """(feature, importance) in falling order; one row per feature."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    rows = [(n.removesuffix("_code"), float(w)) for n, w in zip(names, forest.featureImportances.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_features(model: PipelineModel, k=15) -> DataFrame:
    return importances(model).limit(k)


def evaluate(model: PipelineModel, test: DataFrame, label="label") -> DataFrame:
    """Per-class report on held-out rows."""
    scored = score_events(model, test, [label]).withColumn(label, F.col(label).cast("string"))
    return M.class_report(M.confusion(scored, label, PREDICTED))


def category_codes(model: PipelineModel) -> DataFrame:
    """(category, value, code) of the coded columns; as many rows as the columns have values."""
    rows = [(c.getInputCol(), v, i) for c in model.stages if isinstance(c, StringIndexerModel) for i, v in enumerate(c.labels)]
    return SparkSession.getActiveSession().createDataFrame(rows, "category string, value string, code int")


def column_ablation(train: DataFrame, test: DataFrame, features, suspects, label="label", categorical=(), full: PipelineModel = None,
                    **options) -> DataFrame:
    """Train without the suspect columns on the same split and compare with ``full``, which is trained too if not given."""
    full = full or train_identifier(train, test, features, label, categorical, **options)
    kept = [c for c in features if c not in suspects]
    reduced = train_identifier(train, test, kept, label, [c for c in categorical if c in kept], **options)
    return M.ablation(M.report_summary(evaluate(full, test, label)), M.report_summary(evaluate(reduced, test, label)))
