"""Corpus operators for language-model training data.

Nothing else in the package imports this subpackage.  ``weft.llm.registry``
lists its queries and their DuckDB SQL.
"""
