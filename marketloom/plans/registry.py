"""All registered queries of the market-data library with their DuckDB oracles."""

from __future__ import annotations

from marketloom.plans import q_bars, q_datasets, q_features, q_indicators, q_ml, q_reports, q_signals, q_sources, q_stats, q_streaming

MODULES = (q_features, q_indicators, q_bars, q_datasets, q_stats, q_signals, q_sources, q_streaming, q_ml, q_reports)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
