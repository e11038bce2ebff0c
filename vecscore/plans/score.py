"""From requests to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.functions.features import with_features, with_quantised
from vecscore.functions.schema import K, NPROBE
from vecscore.operators.knn import Q, ivf_neighbours, votes
from vecscore.operators.rules import with_rule
from vecscore.sources.tables import written


def decision(fraud_count: Column) -> tuple[Column, Column]:
    """approved and fraud_score of a vote."""
    return fraud_count < 3, F.round(fraud_count / 5, 1)


def response_json(fraud_count: Column) -> Column:
    approved, score = decision(fraud_count)
    return F.format_string('{"approved":%s,"fraud_score":%s}', approved.cast("string"), score.cast("string"))


def score(tx: DataFrame, vectors: DataFrame, centroids: DataFrame, id_col: str = "event_id", k: int = K, nprobe: int = NPROBE) -> DataFrame:
    """tx: as parse_requests() gives, with id_col. id_col, rule_id, fraud_count, approved, fraud_score. Rules come first; only what they leave open is searched."""
    # read three times below, so computed once
    ruled = written(with_quantised(with_rule(with_features(tx))).select(F.col(id_col).alias("query_id"), "rule_id", "verdict", *Q))
    queries = ruled.filter("verdict = 'Borderline'").select("query_id", *Q)
    searched = votes(queries, ivf_neighbours(queries, vectors, centroids, k, nprobe))
    by_rule = F.when(F.col("verdict") == "Legit", 0).when(F.col("verdict") == "Fraud", 5)
    counted = ruled.filter("verdict <> 'Borderline'").select("query_id", "rule_id", by_rule.alias("fraud_count")).unionByName(searched.select("query_id", F.lit("Borderline").alias("rule_id"), "fraud_count"))
    approved, fraud_score = decision(F.col("fraud_count"))
    return counted.select(F.col("query_id").alias(id_col), "rule_id", "fraud_count", approved.alias("approved"), fraud_score.alias("fraud_score"))
