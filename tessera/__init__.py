"""Semantic-layer analytics engine on Spark."""
