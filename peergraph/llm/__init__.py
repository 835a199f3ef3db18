"""Operators for building language-model training data at scale.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own with a general interface; :mod:`peergraph.llm.registry` holds
the thin ``opN_<name>`` queries over the driver tables.
"""
