"""Training-data operators.  Nothing outside this subpackage imports it.

Importing the subpackage is cheap; every operator lives in a module of its own
and its query in :mod:`marklake.llm.queries`.
"""
