"""Operators for preparing large-scale training corpora (URL, text, media and archive work)."""
