"""Queries of the trace and graph operators with their DuckDB SQL."""


def _load():
    from weft.catalog import core, evidence, experiments, extra, flows, graphs, mining, reports, rules, scores, tabular, traces, vectors

    return core


def all_queries() -> dict:
    """Query by name."""
    return _load().QUERIES


def all_sql() -> dict:
    """SQL by query name."""
    return _load().SQL
