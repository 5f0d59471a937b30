"""Puzzle-corpus analytics on Spark."""
