"""Operators for training-data preparation at corpus scale.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` binds them to the tables.
"""
