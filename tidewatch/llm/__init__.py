"""Operators that prepare text for training a language model; nothing else in the library imports them."""
