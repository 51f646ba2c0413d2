"""Reusable DataFrame operators: deterministic dedupe, exact grouped statistics, wide prices."""
