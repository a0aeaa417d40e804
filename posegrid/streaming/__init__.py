"""Streaming entry points.

The scene contracts define no stream operators; checks that work row by row are
offered for streams because they need no state.
"""
