"""Streams.

The product this library rebuilds has no streaming surface, so nothing is added here. Operators
that work row by row against fixed limits or a fixed plan (``anomalies.event_points``,
``deidentify.apply_plan``, fitted models through ``models.score``) take a streaming DataFrame
unchanged; a test runs one.
"""
