"""Part of lattica; see the package docstring."""
