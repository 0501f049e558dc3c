"""Joins, rankings and the distance join."""
