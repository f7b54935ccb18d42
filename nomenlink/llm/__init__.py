"""Operators on training text: filters, deduplication, token work and packing.

Nothing outside this subpackage imports it. Each module has one operator; ``queries``
registers one query per operator.
"""
