"""All registered queries of the analytics engine and the SQL that must give the same rows."""

from __future__ import annotations

from gable.plans import q_clean, q_features, q_fraud_metrics, q_geo, q_sources, q_stats, q_text

BOOKS = [q_fraud_metrics.book, q_clean.book, q_geo.book, q_text.book, q_stats.book, q_sources.book, q_features.book]
QUERIES = {k: v for b in BOOKS for k, v in b.queries.items()}
ORACLES = {k: v for b in BOOKS for k, v in b.oracles.items()}
