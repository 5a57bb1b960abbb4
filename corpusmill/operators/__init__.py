"""Operators on tables: deduplication, similarity, groups, splits, quality, balancing, statistics, evaluation, export."""
