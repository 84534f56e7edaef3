"""Registered queries over the views of ``derive``."""
