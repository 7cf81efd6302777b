"""Batch scoring and weighted linear classifiers on feature vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from thresher.operators.metrics import weigh_rows
from thresher.operators.ordering import as_list
from thresher.operators.ranking import hardest
from thresher.operators.sampling import oversample
from thresher.session import fresh_path

# Most hard examples that are broadcast to the rows they are taken from.
BROADCAST_ROWS = 100_000


def score_batches(df: DataFrame, features, make_model, width, batch_size=1024, name="score") -> DataFrame:
    """Scores an array column of fixed width with a model, in batches inside the tasks.

    `make_model()` is called once per Python worker and returns a function from a
    (rows, width) array to one number per row.
    """
    udf = predict_batch_udf(make_model, return_type=DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[width]])
    return df.withColumn(name, udf(features))


def linear_scorer(coefficients, intercept):
    """`make_model` for a logistic model; the closure holds only its weights."""
    weights, bias = [float(c) for c in coefficients], float(intercept)

    def make():
        import numpy as np

        vector = np.asarray(weights)

        def predict(batch):
            return 1.0 / (1.0 + np.exp(-(batch.astype("float64") @ vector + bias)))

        return predict

    return make


def train_weighted(df: DataFrame, features, label, family="binomial", classes=None, weight="_weight",
                   iterations=50, regularization=1e-3, **weighing):
    """Fits a logistic model with balancing class weights; returns the fitted model.

    The model is written and read back, which leaves its training summary behind: a summary holds the
    session, and tasks cannot take that once the session has observed a query or tagged a job.
    """
    weighed = weigh_rows(df, label, weight, classes, **weighing) if weight not in df.columns else df
    ready = weighed.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"), weight)
    estimator = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol=weight, family=family, maxIter=iterations, regParam=regularization)
    path = fresh_path(df.sparkSession, "model")
    estimator.fit(ready).write().save(path)
    return LogisticRegressionModel.load(path)


def apply_model(model, df: DataFrame, features, name="probability") -> DataFrame:
    """Adds the class probabilities as an array column."""
    vectors = df.withColumn("_features", array_to_vector(F.col(features)))
    scored = model.setFeaturesCol("_features").setProbabilityCol("_probability").setPredictionCol("_prediction") \
        .setRawPredictionCol("_raw").transform(vectors)
    return scored.withColumn(name, vector_to_array("_probability")).drop("_features", "_probability", "_prediction", "_raw")


def mine_replay_retrain(df: DataFrame, features, label, key, k, repeat, split="split", iterations=50):
    """Trains, mines the k hardest train negatives, replays them and trains again.

    Returns (model before, mined list, model after).
    """
    train = df.filter(F.col(split) == "train")
    before = train_weighted(train, features, label, iterations=iterations)
    weights = before.coefficients.toArray()
    negatives = train.filter(F.col(label) == 0)
    scored = score_batches(negatives, features, linear_scorer(weights, before.intercept), len(weights)).select(*as_list(key), F.round("score", 8).alias("score"))
    mined = hardest(scored, k, "score", key)
    marks = mined.select(*as_list(key)).withColumn("_mined", F.lit(True))
    if k <= BROADCAST_ROWS:  # at most k rows; the feature vectors stay where they are
        marks = F.broadcast(marks)
    marked = train.join(marks, as_list(key), "left")
    replayed = oversample(marked, F.col("_mined").isNotNull(), repeat).drop("_mined")
    after = train_weighted(replayed, features, label, iterations=iterations)
    return before, mined, after
