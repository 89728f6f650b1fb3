"""Structured Streaming entry points (landed pages arriving over time)."""

from sparkeda.streaming.pages import page_element_stream, start_page_extraction

__all__ = ["page_element_stream", "start_page_extraction"]
