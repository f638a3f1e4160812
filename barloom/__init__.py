"""Market research analytics as Spark DataFrame transformations.

Every operator takes and returns DataFrames; symbols, folds, pairs,
portfolios and trials are columns that become partition keys.
"""
