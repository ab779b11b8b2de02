"""Restatements that more than one test module uses."""

from test_dedup import brute_classes
from test_windows_and_lists import brute_hits, plain_spans

__all__ = ["brute_classes", "brute_hits", "plain_spans"]
