"""Timing and motion analytics over tables of attempts, on Spark."""
