"""Declarative quality rules and their evaluation."""
