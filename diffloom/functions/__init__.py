"""Column builders: pure expressions over columns, no shuffles, no actions."""
