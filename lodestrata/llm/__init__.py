"""Operators over text corpora.  Nothing outside this subpackage imports it."""
