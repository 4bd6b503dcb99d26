"""Readers and writers: driver tables (``tables``), corpus files (``files``) and landed
JSON payloads (``payloads``)."""
