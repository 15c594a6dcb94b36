"""Operators for preparing language-model training data, each one a Spark job over whole tables."""
