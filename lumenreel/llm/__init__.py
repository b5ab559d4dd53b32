"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; the registry is in :mod:`lumenreel.llm.queries`.
"""
