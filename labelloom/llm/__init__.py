"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Common rules, stated once: a NULL text counts as the empty text; a NULL doc_id is kept and sorts after every
other id; repeated rows are judged row by row; columns the operator does not know are left
alone, whatever their names (those that start with two underscores are reserved).
"""
