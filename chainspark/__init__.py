"""Event-chain analytics on Spark: DataFrame in, DataFrame out."""

from chainspark.space import StateSpace

__all__ = ["StateSpace"]
