"""Streams: watermarks, state, and sinks that survive a restart.

The event operators marked "batch or stream" take the DataFrames made here.
"""
