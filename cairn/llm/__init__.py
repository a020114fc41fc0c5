"""Operators on text and entities. Nothing else in the library imports this subpackage."""
