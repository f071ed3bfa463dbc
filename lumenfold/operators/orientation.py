"""How a picture is turned: a linear model of its four quarter-turns, trained on the library's own upright pictures.

Nobody labels anything: each upright picture is entered in all four turns, and the model learns to tell them
apart. Class ``k`` means ``k`` quarter-turns against the clock from upright, so that ``90 * k`` degrees clockwise
put it right. Pictures are small grey squares, arrays of their rows' values one after the other.

Training is Spark's multinomial regression: gradients are summed by partition and added in a tree, the driver
holds coefficients alone (4 x values), and a penalty makes the answer one of a kind whatever the partitions.
Turning, scaling and predicting are expressions of the JVM.

What is no square of 2 or more a side, or holds nulls or values that aren't finite, takes no part. Flat
pictures (all values equal) look alike in all turns; they are scaled to zeros. Rows of one id that come again count again.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import formats
from lumenfold.functions import vectors as V

#: A turn is suggested from this probability on.
LEAST = 0.9
#: Fewer upright pictures than these teach nothing.
FEWEST = 200
#: Pictures in training, by years alike; more make training longer and hardly better.
SAMPLES = 3000
PENALTY = 1e-3
ROUNDS = 200


def side(image: Column) -> Column:
    """Values a side of a square; null for what is none."""
    n = F.round(F.sqrt(F.size(image))).cast("int")
    return F.when((n >= 2) & (n * n == F.size(image)), n)


def quarter_turns(image: Column, turns: Column) -> Column:
    """The square turned against the clock. Its place (r, c) comes from (c, last - r) for one turn, and so on."""
    n = side(image)
    r, c = (lambda p: F.floor(p / n)), (lambda p: p % n)
    last = n - 1

    def source(p: Column) -> Column:
        return F.when(turns == 0, p).when(turns == 1, c(p) * n + last - r(p)).when(turns == 2, n * n - 1 - p).otherwise((last - c(p)) * n + r(p))

    return F.when(n.isNotNull(), F.transform(F.sequence(F.lit(0), n * n - 1), lambda p: F.get(image, source(p).cast("int"))))


def scaled(image: Column) -> Column:
    """Values less their mean, by their deviation: brightness and contrast tell nothing of turns."""
    n = F.size(image)
    # Held in arrays of one, else means are made anew for each value.
    moved = F.transform(F.array(V.total(image) / n), lambda m: F.transform(image, lambda x: x - m))
    sized = F.transform(moved, lambda v: F.struct(v.alias("v"), F.sqrt(V.total(F.transform(v, lambda x: x * x)) / n).alias("d")))
    return F.element_at(F.transform(sized, lambda s: F.transform(s["v"], lambda x: F.when(s["d"] > 1e-12, x / s["d"]).otherwise(0.0))), 1)


def usable(images: DataFrame) -> DataFrame:
    """``id`` and ``image`` in doubles of what can be looked at."""
    rows = images.select("id", F.col("image").cast("array<double>").alias("image"))
    bad = F.exists("image", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(side(F.col("image")).isNotNull() & ~bad)


def all_turns(images: DataFrame) -> DataFrame:
    """Each picture four times: ``id``, ``turn`` (0 to 3), ``image`` as it is then."""
    rows = usable(images).select("id", "image", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    return rows.select("id", "turn", quarter_turns(F.col("image"), F.col("turn")).alias("image"))


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(scaled(F.col("image"))))


def upright(files: DataFrame) -> DataFrame:
    """Ids of pictures that are taken to stand upright: nobody has turned them."""
    return files.where((F.col("missing") == 0) & (F.col("kind") == "image") & (F.col("rotation") == 0) & (F.col("content_hash") != "")).select("id")


def train(images: DataFrame, penalty: float = PENALTY, rounds: int = ROUNDS, fewest: int = FEWEST) -> LogisticRegressionModel:
    """A model from upright pictures (``id``, ``image``) of one size; an error if there are fewer than ``fewest`` or sizes differ."""
    sizes = usable(images).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("image")).alias("low"), F.max(F.size("image")).alias("high")).first()
    if sizes.n < fewest:
        raise ValueError(f"{sizes.n} pictures, {fewest} are needed")
    if sizes.n and sizes.low != sizes.high:
        raise ValueError("pictures of several sizes")
    learner = LogisticRegression(
        family="multinomial", labelCol="label", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-7, aggregationDepth=3
    )
    return learner.fit(_features(all_turns(images)).select(F.col("turn").cast("double").alias("label"), "features"))


def predict(model: LogisticRegressionModel, images: DataFrame, *keep: str) -> DataFrame:
    """``id``, ``degrees`` clockwise that put it right (0: upright), ``prob``, and columns of ``images`` to keep. Pictures of other sizes than the model's are left out."""
    rows = images.select("*").where(F.size("image") == model.numFeatures)
    scored = model.transform(_features(rows)).withColumn("p", vector_to_array("probability"))
    best = F.array_position("p", F.array_max("p")) - 1
    return scored.select("id", *keep, formats.turned(F.lit(0), best * 90).cast("int").alias("degrees"), F.array_max("p").alias("prob"))


def suggestions(model: LogisticRegressionModel, files: DataFrame, images: DataFrame, redo: bool = False) -> DataFrame:
    """``id``, ``degrees``, ``prob`` of the pictures in the queue, for ``transitions.record_suggestions``."""
    queue = files.where(P.rotation_queue(redo)).select("id")
    return predict(model, usable(images).join(queue, "id", "left_semi"))


def quality(model: LogisticRegressionModel, images: DataFrame, levels: tuple[float, ...] = (0.0, 0.5, 0.7, LEAST, 0.99)) -> DataFrame:
    """On upright pictures that the model has not seen: at each confidence, how many turns it names, how many of these rightly, of how many."""
    rows = predict(model, all_turns(images), "turn").withColumn("right", F.col("degrees") == F.col("turn") * 90)
    asked = rows.select("right", "prob", F.explode(F.array(*[F.lit(x) for x in levels])).alias("least"))
    sure = F.col("prob") >= F.col("least")
    return asked.groupBy("least").agg(F.count_if(sure).alias("named"), F.count_if(sure & F.col("right")).alias("right"), F.count(F.lit(1)).alias("n"))


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> LogisticRegressionModel | None:
    """The model stored there; None if none was."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return LogisticRegressionModel.load(path)
