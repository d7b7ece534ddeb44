"""The group-by and filter operators over unbounded input."""

from tessera.streaming.grouped import stream_group

__all__ = ["stream_group"]
