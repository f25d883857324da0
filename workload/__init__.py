"""Queries over the given tables, each with the SQL it is checked against.

The tables hold few identity numbers and no addresses or boxes, so some inputs
are derived from their keys by plain arithmetic.  A derivation is written once,
in SQL both engines understand; the operators under test are not shared.
"""
