"""Scalar functions over reads: Column builders, and vectorised ones where SQL has none."""
