"""Structured Streaming forms: the same per-row operators on streams, and windowed state with watermarks."""

from .windows import by_session, by_window, first_of_each, run_to_table

__all__ = ["by_session", "by_window", "first_of_each", "run_to_table"]
