"""Differential testing engines; every engine returns the standard result table."""
