"""Reflection and paired-variant analytics on Spark DataFrames.

Frames are tables of pixels keyed by ``scene, frame, y, x``; every operator takes a
DataFrame and returns a DataFrame.
"""

from glintframe.session import build_session, materialize

__all__ = ["build_session", "materialize"]
