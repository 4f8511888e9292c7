"""Structured Streaming: windowed aggregates and incremental runs."""

from sluice.streaming.windows import counted_windows, files, run_once, sessions, windowed

__all__ = ["counted_windows", "files", "run_once", "sessions", "windowed"]
