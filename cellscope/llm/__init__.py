"""Operators for preparing large text corpora (training data) with Spark.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and column names and returns a DataFrame; ``queries`` registers one
production query per operator.
"""
