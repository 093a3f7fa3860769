"""Training-data operators: one module per operator, plus the registry in :mod:`.queries`."""
