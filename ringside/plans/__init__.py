"""Queries register themselves when the package is imported, whichever of its modules is asked for first."""

from ringside.plans import contest_queries, model_queries, source_queries, stream_queries, text_queries, view_queries  # noqa: F401
