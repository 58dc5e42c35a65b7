"""Structured Streaming: regression watch over arriving plan runs."""

from checkup.streaming.watch import RegressionWatch, replay_as_stream  # noqa: F401
