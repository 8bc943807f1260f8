"""Operators for preparing training text: ten jobs on documents, pages and conversations.

Nothing else in the package imports this subpackage; removing the folder leaves the rest intact.
"""
