"""Fitted models on streams.

A fitted scaler, normaliser or regressor is a stateless projection, so it holds
for a streaming DataFrame as it stands: no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def apply_model(model, stream: DataFrame) -> DataFrame:
    """The stream through ``model.predict`` or ``model.transform``."""
    if not stream.isStreaming:
        raise ValueError("the DataFrame is not a stream; use the model itself")
    return model.predict(stream) if hasattr(model, "predict") else model.transform(stream)
