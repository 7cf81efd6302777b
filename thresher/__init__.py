"""Spark operators for curating labelled datasets and evaluating classifiers."""
