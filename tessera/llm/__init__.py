"""Training-data operators: one module each, their queries in ``queries``.

Nothing outside this subpackage imports it.
"""
