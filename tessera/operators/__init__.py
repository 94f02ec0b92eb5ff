"""Profiling as DataFrame jobs."""
