"""Operators for preparing language-model training text at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``contract.py`` holds the thin queries that
derive the registered ``opN_*`` results from them.
"""
