"""Operators that prepare text for training language models, each a Spark job."""
