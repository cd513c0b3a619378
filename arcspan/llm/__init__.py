"""Operators that prepare data for language models. Nothing outside this subpackage imports it."""
