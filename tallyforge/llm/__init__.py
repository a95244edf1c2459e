"""Operators on the texts that feed language models; nothing outside this subpackage imports it."""
