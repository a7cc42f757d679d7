"""Training-data operators. Nothing else in packframe imports this subpackage."""
