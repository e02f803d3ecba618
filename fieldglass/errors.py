"""Typed errors raised while a job is being built."""


class InsufficientHistoryError(ValueError):
    """There is no earlier data to compute the value from."""


class MissingColumnsError(ValueError):
    """A required input column is absent."""
