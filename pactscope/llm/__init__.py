"""Operators that prepare text corpora for training: ten operators, their queries and reference SQL."""
