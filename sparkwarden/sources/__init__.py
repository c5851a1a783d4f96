"""Log sources, event and alert tables."""
