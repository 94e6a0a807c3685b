"""Structured Streaming: incremental folder ingest of order files."""

from orderlens.streaming.ingest import folder_stream, ingest_folder, process_batch

__all__ = ["folder_stream", "ingest_folder", "process_batch"]
