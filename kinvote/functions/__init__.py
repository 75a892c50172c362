"""Column-level functions: ``Column -> Column``, no shuffles."""
