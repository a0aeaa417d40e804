"""Row rules over a stream: the same columns as in batch, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.rules import Rule, violations


def stream_violations(stream: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """Breaches of row rules in a streaming DataFrame; any output mode but complete."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return violations(stream, rules, *keys)
