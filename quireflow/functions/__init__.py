"""See the package docstring of quireflow."""
