"""DNS analysis: heuristics and a random forest on domain names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dns import (
    BASE64_LABEL,
    FEATURES,
    HEX_LABEL,
    SUSPICIOUS_ENTROPY,
    SUSPICIOUS_LENGTH,
    domain_features,
    first_label,
    shannon_entropy,
)
from ..session import shared_dir
from .normalise import metadata_get

NORMAL = "normal"
TUNNELING = "tunneling_suspect"
DGA = "dga_suspect"
MIN_TRAINING_ROWS = 20


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns through a generator, one row to one row.

    Filters further up then read them instead of a copy of their expressions.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def dns_analysis(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds length, entropy, encodings and a verdict for the first label."""
    label = first_label(F.col(domain))
    measured = _once(
        df,
        {
            "subdomain_length": F.length(label),
            "subdomain_entropy": shannon_entropy(label),
            "has_hex_encoding": label.rlike(HEX_LABEL),
            "has_base64_encoding": label.rlike(BASE64_LABEL),
        },
    )
    long_and_random = (F.col("subdomain_entropy") > SUSPICIOUS_ENTROPY) & (
        F.col("subdomain_length") > SUSPICIOUS_LENGTH
    )
    return measured.withColumn("suspicious", long_and_random | F.col("has_hex_encoding"))


def dns_features(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds the eight classifier features as DOUBLE columns."""
    return _once(df, domain_features(F.col(domain)))


def heuristic(entropy: Column, length: Column, digits: Column, has_hex: Column) -> Column:
    """Label and confidence from fixed limits, first match wins."""

    def verdict(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    return (
        F.when((has_hex > 0.5) & (length > 16), verdict(TUNNELING, 0.85))
        .when((entropy > 3.8) & (digits > 0.4) & (length > 12), verdict(DGA, 0.70))
        .when((entropy > 4.0) & (length > 20), verdict(TUNNELING, 0.65))
        .otherwise(verdict(NORMAL, 0.90))
    )


def dns_heuristic(featured: DataFrame) -> DataFrame:
    """Adds ``label`` and ``confidence`` to rows that carry the features."""
    verdict = heuristic(
        F.col("entropy"), F.col("subdomain_length"), F.col("digit_ratio"), F.col("has_hex")
    )
    return featured.withColumn("_verdict", verdict).select(
        "*", "_verdict.label", "_verdict.confidence"
    ).drop("_verdict")


@dataclass(frozen=True)
class DnsForest:
    """A fitted pipeline and its class names in index order."""

    model: PipelineModel
    labels: tuple[str, ...]


def fit_dns_forest(
    df: DataFrame,
    label: str = "label",
    domain: str = "domain",
    n_trees: int = 100,
    max_depth: int = 10,
    seed: int = 42,
    path: str | None = None,
) -> DnsForest | None:
    """Random forest on labelled domains; None below the minimum row count.

    The model is stored, at ``path`` or in the shared folder, and used as it is read
    back: a freshly fitted one drags its training summary, and with that the session,
    into every task.
    """
    # Only as many rows as the minimum are counted.
    if df.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
        return None
    stages = [
        StringIndexer(
            inputCol=label, outputCol="_label_index", stringOrderType="alphabetAsc"
        ),
        VectorAssembler(inputCols=list(FEATURES), outputCol="_features"),
        RandomForestClassifier(
            labelCol="_label_index",
            featuresCol="_features",
            predictionCol="_predicted",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            numTrees=n_trees,
            maxDepth=max_depth,
            seed=seed,
        ),
    ]
    model = Pipeline(stages=stages).fit(dns_features(df.select(domain, label), domain))
    path = path or shared_dir(df.sparkSession, "dns-forest")
    model.write().save(path)
    return load_dns_forest(path)


def load_dns_forest(path: str) -> DnsForest:
    model = PipelineModel.load(path)
    return DnsForest(model, tuple(model.stages[0].labels))


def classify_dns(
    df: DataFrame, model: DnsForest | None = None, domain: str = "domain"
) -> DataFrame:
    """Adds ``label``, ``confidence`` and a ``features`` map; heuristic without a model."""
    featured = dns_features(df, domain)
    if model is None:
        labelled = dns_heuristic(featured)
    else:
        # The assembler and the forest; the label indexer is only for fitting.
        scored = featured
        for stage in model.model.stages[1:]:
            scored = stage.transform(scored)
        names = F.array(*[F.lit(x) for x in model.labels])
        labelled = (
            scored.withColumn("_p", vector_to_array("_probability"))
            .withColumn("confidence", F.array_max("_p"))
            .withColumn(
                "label",
                F.element_at(names, F.array_position("_p", F.col("confidence")).cast("int")),
            )
            .drop("_features", "_raw", "_probability", "_predicted", "_p")
        )
    features = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])
    return labelled.withColumn("features", features).drop(*FEATURES)


def dns_queries(events: DataFrame) -> DataFrame:
    """DNS query events that name a domain, with it as a column."""
    return (
        events.filter(F.col("event_type") == "dns_query")
        .withColumn("domain", metadata_get("domain", None))
        .filter(F.col("domain") != "")
    )
