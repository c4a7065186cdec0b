"""Registered queries, the relations they run on, and their SQL."""
