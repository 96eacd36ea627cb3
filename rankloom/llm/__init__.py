"""Operators that prepare text corpora for training language models; nothing else in the package imports them."""
