"""Re-applying a saved preparation spec to data as it arrives."""

from .replay import replay_stream  # noqa: F401
