"""Training-data operators: one module for each operator, their queries in :mod:`rankloom.llm.queries`.

Nothing outside this subpackage imports it.
"""
