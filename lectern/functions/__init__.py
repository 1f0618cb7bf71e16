"""Functions of the text and catalog engine."""
