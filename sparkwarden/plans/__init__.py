"""Jobs composed of operators, and the registered queries."""
