"""Column builders: identifiers, text, dates, places and status."""
