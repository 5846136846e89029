"""Operators for preparing training corpora; nothing else in linkloom imports this subpackage.

Each module holds one operator with its own interface and a thin ``query`` that applies it to the
intended table.  ``registry`` lists the queries and their SQL.
"""
