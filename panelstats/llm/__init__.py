"""Operators of a training-data pipeline: one module per operator, each a function from
DataFrame(s) to a DataFrame.  ``queries`` and ``oracle`` register them; nothing else in
the library imports this subpackage."""
