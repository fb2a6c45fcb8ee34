"""Operators that prepare training text at scale.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface;
``queries`` binds them to the registered ``opN_*`` queries.
"""
