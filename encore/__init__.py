"""Repeat-purchase analytics on Spark: DataFrame in, DataFrame out."""

from encore.config import FeatureParams, ForestParams, GbtParams

__all__ = ["FeatureParams", "ForestParams", "GbtParams"]
