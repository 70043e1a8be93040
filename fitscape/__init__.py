"""Spark jobs for protein-fitness tables: preparation, alignments, splits, graphs, features, metrics."""
