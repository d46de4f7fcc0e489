"""Classifiers of the complaint -> category -> subcategory cascade, and scoring."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel,
)
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.operators.features import VectorizerConfig
from trendloom.operators.splits import SplitConfig
from trendloom.session import cut_lineage


@dataclass(frozen=True)
class TrainConfig:
    """Text, tokens, split, features and kinds of the cascade's models.

    Denied tokens are those of the files ``token_files`` in ``token_dir``, or ``deny_tokens`` without a folder.
    """

    text_field: str = "client_first_message"
    token_dir: str | None = None
    token_files: tuple[str, ...] = ("deny_tokens.txt", "extra_stopwords.txt")
    deny_tokens: tuple[str, ...] = fv.DENY_TOKENS + fv.EXTRA_STOPWORDS
    split: SplitConfig = field(default_factory=SplitConfig)
    vectorizer: VectorizerConfig = field(default_factory=VectorizerConfig)
    complaint_classifier: str = "logreg"
    complaint_iterations: int = fv.COMPLAINT_ITERATIONS
    complaint_threshold: float = fv.COMPLAINT_THRESHOLD
    category_classifier: str = "linearsvc"
    category_iterations: int = fv.CATEGORY_ITERATIONS

FEATURES = "features"


def predicted(score: Column, threshold: float) -> Column:
    return score >= threshold


# --- label codes -------------------------------------------------------------------------

@dataclass(frozen=True)
class LabelCodes:
    """Alphabetical codes of a string label."""

    labels: list[str]

    @classmethod
    def fit(cls, df: DataFrame, label: str) -> LabelCodes:
        indexer = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc")
        return cls(list(indexer.fit(df.filter(F.col(label).isNotNull())).labels))

    def encode(self, df: DataFrame, label: str, code: str) -> DataFrame:
        return StringIndexerModel.from_labels(self.labels, label, code).transform(df)

    def decode(self, df: DataFrame, code: str, label: str) -> DataFrame:
        return IndexToString(inputCol=code, outputCol=label, labels=self.labels).transform(df)


# --- binary complaint model ----------------------------------------------------------------
# With balanced weights the weights sum to the row count, so regParam = 1 / rows puts the
# optimum where a unit penalty constant does.


FOLD_BUCKET_BITS = 12

# Relative improvement at which the optimisers stop.
TOLERANCE = 1e-4


# Optimisers run a job per step, so a small training table is packed into few partitions.
ROWS_PER_PARTITION = 10_000


def with_folds(df: DataFrame, label: str, row_id: str, folds: int, name: str = "_fold") -> DataFrame:
    """Add a fold number: the rank of a row inside its class, in the order of a hash of its id, modulo ``folds``.

    So every fold holds its share of every class, to a row.  Ranks are exact without a window over
    a class: rows are ranked inside buckets of the hash, and only counts per class and bucket are ordered.
    """
    order = F.xxhash64(F.col(row_id).cast("string"))
    placed = df.withColumns({"_hash": order, "_bucket": F.shiftright(order, 64 - FOLD_BUCKET_BITS)})
    counts = placed.groupBy(F.col(label).alias("_label"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_label", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", F.col(row_id).cast("string"))
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b"))
    numbered = ranked.join(counts, same).withColumn(name, F.pmod(F.col("_before") + F.col("_rank"), F.lit(folds)).cast("int"))
    return numbered.drop("_hash", "_bucket", "_label", "_b", "_before", "_rank")


def _repeats(df: DataFrame, label: str) -> bool:
    """Whether rows of one vector and label are common enough to count them instead of reading each in every step."""
    same = F.xxhash64(F.unwrap_udt(FEATURES), label)
    sizes = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(same).alias("distinct")).first()
    return sizes["rows"] > 4 * sizes["distinct"]


def _counted(df: DataFrame, label: str, *others: str, repeats: bool) -> DataFrame:
    """(features, label, others, _n), written once: rows that are equal in all of these as one with their number.

    A loss sums over rows, so ``_n`` rows are one of ``_n`` times the weight and the optimum stays; a
    step of the optimiser costs what the distinct rows do.
    """
    keys = [FEATURES, label, *others]
    if not repeats:
        return cut_lineage(df.select(*keys, F.lit(1).cast("long").alias("_n")))
    return cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")))


def _balanced(counted: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Counted rows with the balanced class weight times their number, in few partitions, and the number of all rows."""
    classes = {r[label]: (r["all"], r["kinds"]) for r in counted.groupBy(label).agg(F.sum("_n").alias("all"), F.count("*").alias("kinds")).collect()}
    rows = sum(n for n, _ in classes.values())
    shares = counted.sparkSession.createDataFrame(
        [(c, rows / (len(classes) * n)) for c, (n, _) in classes.items()], "_class double, _share double"
    )
    weighted = counted.join(F.broadcast(shares), F.col(label) == F.col("_class")).withColumn("weight", F.col("_share") * F.col("_n"))
    return _packed(weighted.select(FEATURES, label, "weight"), sum(k for _, k in classes.values())), rows


def _packed(df: DataFrame, rows: int) -> DataFrame:
    wanted = max(1, -(-rows // ROWS_PER_PARTITION))
    return df.coalesce(wanted)  # never raises the number of partitions


def _logistic(rows: int, iterations: int, label: str, weight: str | None = "weight", **extra) -> LogisticRegression:
    model = LogisticRegression(
        featuresCol=FEATURES, labelCol=label, regParam=1.0 / rows, elasticNetParam=0.0, standardization=False,
        maxIter=iterations, tol=TOLERANCE, aggregationDepth=3, **extra,
    )
    return model.setWeightCol(weight) if weight else model


def _margin_model(rows: int, label: str, iterations: int = 50) -> LinearSVC:
    return LinearSVC(
        featuresCol=FEATURES, labelCol=label, weightCol="weight", regParam=1.0 / rows, standardization=False,
        maxIter=iterations, tol=TOLERANCE, aggregationDepth=3,
    )


class LogisticComplaint:
    """Balanced logistic regression; the score is its probability."""

    kind = "logreg"

    def __init__(self, model: LogisticRegressionModel):
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, cfg: TrainConfig) -> LogisticComplaint:
        known = df.filter("y IS NOT NULL")
        weighted, _ = _balanced(_counted(known, "y", repeats=_repeats(known, "y")), "y")
        return cls(_logistic(df.count(), cfg.complaint_iterations, "y").fit(weighted))

    def score(self, df: DataFrame, name: str) -> DataFrame:
        scored = self.model.transform(df)
        return scored.withColumn(name, vector_to_array("probability")[1]).drop(
            "probability", "rawPrediction", "prediction"
        )

    def save(self, path: str) -> None:
        self.model.write().save(path)

    @classmethod
    def load(cls, path: str, meta: dict) -> LogisticComplaint:
        return cls(LogisticRegressionModel.load(path))


class CalibratedComplaint:
    """Linear margin models on the complements of five folds, each with a logistic
    calibration on its fold; the score is the mean calibrated probability."""

    kind = "linearsvc"
    FOLDS = 5

    def __init__(self, margins: list[LinearSVCModel], curves: list[tuple[float, float]]):
        self.margins = margins
        self.curves = curves

    @classmethod
    def fit(cls, df: DataFrame, cfg: TrainConfig, row_id: str = "row_id") -> CalibratedComplaint:
        numbered = with_folds(df.select(row_id, "y", FEATURES), "y", row_id, cls.FOLDS)
        folds = _counted(numbered, "y", "_fold", repeats=_repeats(df, "y"))
        margins, curves = [], []
        for i in range(cls.FOLDS):
            weighted, rows = _balanced(folds.filter(F.col("_fold") != i), "y")
            margin = _margin_model(rows, "y").fit(weighted)
            held = margin.transform(folds.filter(F.col("_fold") == i))
            margins.append(margin)
            curves.append(cls._curve(held.select(vector_to_array("rawPrediction")[1].alias("margin"), "y", "_n")))
        return cls(margins, curves)

    @staticmethod
    def _curve(held: DataFrame) -> tuple[float, float]:
        """Slope and intercept of the logistic curve over smoothed targets; ``_n`` is the number of rows that a row stands for.

        A fold without rows of a class (fewer than ``FOLDS`` of them in all) still has smoothed targets of both.  A smoothed target t is one row of class 1 with weight t and one of class 0
        with weight 1 - t.
        """
        sizes = held.agg(*[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("_n"))), F.lit(0)).alias(name) for c, name in ((1, "p"), (0, "n"))]).first()
        if sizes["p"] + sizes["n"] == 0:  # fewer rows than folds
            return 1.0, 0.0
        high, low = (sizes["p"] + 1.0) / (sizes["p"] + 2.0), 1.0 / (sizes["n"] + 2.0)
        target = F.when(F.col("y") == 1, F.lit(high)).otherwise(F.lit(low))
        soft = held.select(
            "margin", "_n",
            F.explode(
                F.array(
                    F.struct(F.lit(1.0).alias("label"), target.alias("weight")),
                    F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight")),
                )
            ).alias("t"),
        ).select("margin", "t.label", (F.col("t.weight") * F.col("_n")).alias("weight"))
        vectors = VectorAssembler(inputCols=["margin"], outputCol=FEATURES).transform(soft)
        curve = LogisticRegression(
            featuresCol=FEATURES, labelCol="label", weightCol="weight", standardization=False, maxIter=200
        ).fit(vectors)
        return float(curve.coefficients[0]), float(curve.intercept)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        out, parts = df, []
        for i, (margin, (slope, shift)) in enumerate(zip(self.margins, self.curves)):
            model = margin.copy().setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}")
            out = model.transform(out).drop(f"_pred{i}")
            parts.append(1 / (1 + F.exp(-(slope * vector_to_array(f"_raw{i}")[1] + shift))))
        mean = sum(parts[1:], parts[0]) / len(parts)
        return out.withColumn(name, mean).drop(*[f"_raw{i}" for i in range(len(parts))])

    def save(self, path: str) -> None:
        for i, margin in enumerate(self.margins):
            margin.write().save(f"{path}/margin_{i}")

    @classmethod
    def load(cls, path: str, meta: dict) -> CalibratedComplaint:
        curves = [tuple(c) for c in meta["curves"]]
        return cls([LinearSVCModel.load(f"{path}/margin_{i}") for i in range(len(curves))], curves)


def fit_complaint(df: DataFrame, cfg: TrainConfig, row_id: str = "row_id"):
    """Complaint model on ``features`` and the 0/1 label ``y``."""
    if cfg.complaint_classifier == "linearsvc":
        return CalibratedComplaint.fit(df, cfg, row_id)
    return LogisticComplaint.fit(df, cfg)


# --- multi-class models ----------------------------------------------------------------------

class ClassModel:
    """A multi-class model with its label codes; one class needs no model at all."""

    def __init__(self, codes: LabelCodes, model=None):
        self.codes = codes
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, label: str, classifier: str, iterations: int) -> ClassModel:
        """``df`` holds complaint rows only."""
        known = df.filter(F.col(label).isNotNull())
        codes = LabelCodes.fit(known, label)
        if len(codes.labels) < 2:
            return cls(codes)
        coded = codes.encode(known, label, "_code")
        weighted, rows = _balanced(_counted(coded, "_code", repeats=_repeats(coded, "_code")), "_code")
        weighted = weighted.persist()
        try:
            if classifier == "logreg":
                model = _logistic(rows, iterations, "_code", family="multinomial").fit(weighted)
            else:
                model = OneVsRest(
                    classifier=_margin_model(rows, "_code"), featuresCol=FEATURES, labelCol="_code", weightCol="weight"
                ).fit(weighted)
        finally:
            weighted.unpersist()
        return cls(codes, model)

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        if not self.codes.labels:
            return df.withColumn(name, F.lit(None).cast("string"))
        if self.model is None:
            return df.withColumn(name, F.lit(self.codes.labels[0]))
        coded = self.model.transform(df)
        return self.codes.decode(coded, "prediction", name).drop("prediction", "rawPrediction", "probability")

    def save(self, path: str) -> None:
        if self.model is not None:
            self.model.write().save(path)

    @classmethod
    def load(cls, path: str, meta: dict | None) -> ClassModel | None:
        if meta is None:
            return None
        model = None
        if meta["kind"] == "logreg":
            model = LogisticRegressionModel.load(path)
        elif meta["kind"] == "one_vs_rest":
            model = OneVsRestModel.load(path)
        return cls(LabelCodes(meta["labels"]), model)

    def meta(self) -> dict:
        kind = "constant"
        if self.model is not None:
            kind = "logreg" if isinstance(self.model, LogisticRegressionModel) else "one_vs_rest"
        return {"labels": self.codes.labels, "kind": kind}


def fit_category(df: DataFrame, label: str, cfg: TrainConfig) -> ClassModel:
    return ClassModel.fit(df, label, cfg.category_classifier, cfg.category_iterations)


def fit_subcategory(df: DataFrame, label: str, cfg: TrainConfig) -> ClassModel | None:
    """Subcategory model, or none when the complaints know fewer than two."""
    filled = df.withColumn(label, F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit(fv.UNKNOWN)))
    model = ClassModel.fit(filled, label, "logreg", cfg.category_iterations)
    return model if model.model is not None else None


# --- the cascade -------------------------------------------------------------------------------

@dataclass
class Cascade:
    """Vectorizer and the three models of a training run."""

    vectorizer: object
    complaint: LogisticComplaint | CalibratedComplaint
    category: ClassModel
    subcategory: ClassModel | None

    def score(self, df: DataFrame, threshold: float) -> DataFrame:
        """Add the complaint score and verdict, the category and the subcategory.

        Only complaint rows go through the class models; the others get the neutral
        codes.
        """
        scored = self.complaint.score(df, "complaint_score").withColumn(
            "is_complaint_pred", predicted(F.col("complaint_score"), threshold)
        )
        scored = cut_lineage(scored)  # both branches read it: no row is vectorised and scored twice
        bad = self.category.predict(scored.filter("is_complaint_pred"), "category_pred")
        bad = bad.withColumn("category_pred", F.coalesce("category_pred", F.lit(fv.OTHER)))
        if self.subcategory is not None:
            bad = self.subcategory.predict(bad, "subcategory_pred")
        else:
            bad = bad.withColumn("subcategory_pred", F.lit(fv.NOT_COMPLAINT))
        rest = scored.filter(~F.col("is_complaint_pred")).withColumns(
            {"category_pred": F.lit(fv.OTHER), "subcategory_pred": F.lit(fv.NOT_COMPLAINT)}
        )
        return bad.unionByName(rest)

    def save(self, spark: SparkSession, root: str) -> str:
        """Write everything to a fresh folder under ``root`` and return it."""
        path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        for name in ("word", "char"):
            getattr(self.vectorizer, name).table(spark).write.parquet(f"{path}/{name}_vocabulary")
        self.complaint.save(f"{path}/complaint")
        self.category.save(f"{path}/category")
        if self.subcategory is not None:
            self.subcategory.save(f"{path}/subcategory")
        meta = {
            "complaint": {"kind": self.complaint.kind, "curves": getattr(self.complaint, "curves", None)},
            "category": self.category.meta(),
            "subcategory": self.subcategory.meta() if self.subcategory else None,
        }
        spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, vectorizer_cfg) -> Cascade:
        from trendloom.operators.features import TermBlock, Vectorizer

        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        word, char = (TermBlock.from_table(spark.read.parquet(f"{path}/{n}_vocabulary")) for n in ("word", "char"))
        kinds = {c.kind: c for c in (LogisticComplaint, CalibratedComplaint)}
        return cls(
            Vectorizer(vectorizer_cfg, word, char),
            kinds[meta["complaint"]["kind"]].load(f"{path}/complaint", meta["complaint"]),
            ClassModel.load(f"{path}/category", meta["category"]),
            ClassModel.load(f"{path}/subcategory", meta["subcategory"]),
        )
