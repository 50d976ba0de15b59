"""Operators for building large text corpora: one module per operator, ``queries`` registers them."""
