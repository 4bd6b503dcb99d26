"""Shared corpus tables (``corpus``), the registered query catalog (``catalog``) and the
SQL statements of the correctness oracle (``oracles``, ``sqltext``)."""
