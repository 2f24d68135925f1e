"""Reusable plan shapes: ordered windows over hot keys, exact quantiles, block scoring, graph labels."""
