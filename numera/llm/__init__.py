"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator lives in its own
module; ``registry`` holds the thin ``opN_<name>`` queries built on them.
"""
