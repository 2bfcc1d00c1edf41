"""All queries of the library, gathered from its modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["store", "calendar", "coverage", "indicators", "labels", "session_labels", "structure", "matching", "forecasts", "fan", "features", "scoring", "walk", "judging", "resampling", "receipts", "openings", "distributions", "archive", "preview", "usuals", "records", "models"]


def modules():
    return [import_module(f"barline.operators.{m}") for m in MODULES] + [import_module("barline.streaming.bars")]


def queries() -> dict:
    return {k: v for m in modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in modules() for k, v in m.SQL.items()}
