"""Training-data operators: scoring, filters, near duplicates, packing and archives.

Nothing outside this package imports it. ``queries`` registers one query per operator.
"""
