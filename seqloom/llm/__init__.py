"""Operators for preparing language-model training data at corpus scale.

Thirteen operators (one module each) plus ``queries``, which registers the thin
``opN_*`` queries. Nothing else in the library imports this subpackage.
"""
