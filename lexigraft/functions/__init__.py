"""Column -> Column building blocks: no shuffles, no actions."""
