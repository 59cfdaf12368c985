"""Failures of a job, with their return codes."""

from __future__ import annotations


class AggregationError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
