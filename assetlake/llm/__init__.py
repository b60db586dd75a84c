"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` binds
them to the tables of the driver contract.
"""
