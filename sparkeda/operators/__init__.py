"""Operators: profiles, cleaning, nested data, web pages, link graphs, learning."""
