"""Readers for transcript files and source trees."""
