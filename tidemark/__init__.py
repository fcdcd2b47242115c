"""Leak-free event-signal research on Spark: point-in-time panels, walk-forward scores, evaluation."""
