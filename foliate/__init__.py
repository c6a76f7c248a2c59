"""Classify, group and order document pages with Spark, by declarative policies."""
