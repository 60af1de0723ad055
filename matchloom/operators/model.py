"""A gradient-boosted matcher on MLlib, with validation, scoring and persistence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAIR, LinkageError, NotFittedError, SchemaError
from .features import align

DEFAULTS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}


def check_labels(df: DataFrame) -> None:
    if df.isEmpty():
        raise LinkageError("no rows")
    if not df.where(F.col("label").isNull() | ~F.col("label").isin(0, 1)).isEmpty():
        raise LinkageError("labels other than 0 and 1")


@dataclass
class Matcher:
    features: list[str]
    params: dict = field(default_factory=dict)
    model: PipelineModel | None = None

    def __post_init__(self) -> None:
        if not self.features or len(set(self.features)) != len(self.features):
            raise SchemaError("features must be given, each once")

    def fit(self, df: DataFrame) -> Matcher:
        """Train on a frame with the features and `label`."""
        check_labels(df)
        align(df, self.features)
        assembler = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="error")
        trees = GBTClassifier(featuresCol="features", labelCol="label", **DEFAULTS | self.params)
        self.model = Pipeline(stages=[assembler, trees]).fit(df.select(*self.features, F.col("label").cast("double").alias("label")))
        return self

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise NotFittedError("the matcher isn't trained")
        return self.model

    def score(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Ids, the columns to keep and match_probability; the ids travel in the same rows."""
        model = self._fitted()
        return model.transform(align(df, self.features, keep)).select(*PAIR, *keep, vector_to_array("probability")[1].alias("match_probability"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", (F.col("match_probability") >= 0.5).cast("int"))

    def importance(self, spark: SparkSession) -> DataFrame:
        """feature, gain (its share) and splits, most important first."""
        trees = self._fitted().stages[-1]
        gain = trees.featureImportances.toArray().tolist()
        splits = [0] * len(self.features)
        for tree in trees.trees:
            for line in tree.toDebugString.splitlines():
                if line.strip().startswith("If (feature "):
                    splits[int(line.split("(feature ")[1].split()[0])] += 1
        rows = list(zip(self.features, gain, splits, strict=True))
        return spark.createDataFrame(rows, "feature string, gain double, splits int").orderBy(F.desc("gain"), "feature")

    def save(self, path: str, metadata: dict | None = None) -> None:
        self._fitted().write().overwrite().save(f"{path}/model")
        row = [(self.features, {k: str(v) for k, v in (metadata or {}).items()})]
        SparkSession.active().createDataFrame(row, "features array<string>, metadata map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> tuple[Matcher, dict[str, str]]:
        row = spark.read.schema("features array<string>, metadata map<string,string>").json(f"{path}/metadata").first()
        return Matcher(list(row["features"]), model=PipelineModel.load(f"{path}/model")), dict(row["metadata"] or {})


@dataclass
class Training:
    matcher: Matcher
    train_rows: int
    train_positive_rate: float
    valid_rows: int | None = None
    valid_positive_rate: float | None = None
    valid_logloss: float | None = None


def shape(df: DataFrame) -> tuple[int, float]:
    """Rows and positive rate."""
    row = df.agg(F.count(F.lit(1)), F.avg("label")).first()
    return row[0], row[1]


def logloss(scored: DataFrame) -> float | None:
    """Mean binary cross-entropy of match_probability against label; None without rows."""
    p = F.least(F.greatest("match_probability", F.lit(1e-15)), F.lit(1 - 1e-15))
    return scored.agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))).first()[0]


def train(df: DataFrame, features: list[str], valid: DataFrame | None = None, **params) -> Training:
    """A trained matcher and the shape of what it saw; the validation rows are described and scored, never trained on."""
    matcher = Matcher(features, params).fit(df)
    if valid is None:
        return Training(matcher, *shape(df))
    loss = logloss(matcher.score(valid, ("label",)))
    return Training(matcher, *shape(df), *shape(valid), loss)


def scores_to_map(scored: DataFrame) -> DataFrame:
    """source1_entity_id, scores (map of candidate to probability), after checks of ids, range and repetition."""
    if missing := [c for c in (*PAIR, "match_probability") if c not in scored.columns]:
        raise SchemaError(f"missing columns {missing}")
    p = F.col("match_probability")
    wrong = F.col(PAIR[0]).isNull() | F.col(PAIR[1]).isNull() | p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    if scored.isEmpty():
        raise LinkageError("no scores")
    if not scored.where(wrong).isEmpty():
        raise LinkageError("null ids, or probabilities outside [0, 1]")
    if not scored.groupBy(*PAIR).count().where("count > 1").isEmpty():
        raise LinkageError("repeated pairs")
    return scored.groupBy(PAIR[0]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(PAIR[1], "match_probability")))).alias("scores"))
