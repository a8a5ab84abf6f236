"""Operators for building training corpora; nothing outside this subpackage imports it."""
