"""corpusmill: Spark operators for building, cleaning, splitting and evaluating instruction corpora.

functions: columns for text, keys, JSON and schemas. operators: tables in, tables out (duplicates, groups, splits, quality,
balance, statistics, evaluation, export, generators, reports). sources: JSON lines. nested: nested records as flat tables.
boundary: models and services behind a client. llm: operators for training data, which nothing here imports.
"""

__version__ = "0.2.0"
