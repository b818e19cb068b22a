"""Operators that prepare text for training: ten of them, each usable by itself, and their queries."""
