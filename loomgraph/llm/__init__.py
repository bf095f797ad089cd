"""Operators for building language-model training data. Nothing else in loomgraph imports this subpackage."""
