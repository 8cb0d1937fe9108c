"""Training-data operators: similarity joins, packing, search, scans, cleaning, tokenising, scoring.

Nothing else in the library imports this subpackage. Each module holds one operator; ``registry``
lists the thin ``opN_<name>`` queries and their SQL.
"""
