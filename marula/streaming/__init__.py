"""Structured streaming: see windows."""
