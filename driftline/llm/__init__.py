"""Training-data pipeline operators: one module per operator, plus their queries.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
