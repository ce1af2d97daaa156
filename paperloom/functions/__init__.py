"""Part of paperloom: see the package docstring."""
