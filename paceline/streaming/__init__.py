"""Incremental forms of the rules that suit a live feed."""
