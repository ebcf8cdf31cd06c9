"""Operators for preparing large text collections; ``queries`` applies them to whole tables."""
