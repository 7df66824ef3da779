"""All queries outside the subpackage for training text."""

from __future__ import annotations

from . import core_problems, corpus_queries, diff_queries, operator_queries

QUERIES = {**core_problems.QUERIES, **corpus_queries.QUERIES, **diff_queries.QUERIES, **operator_queries.QUERIES}
SQL = {**core_problems.SQL, **corpus_queries.SQL, **diff_queries.SQL, **operator_queries.SQL}

flagship = diff_queries.line_multiset_diff
