"""Streaming of the course-transfer engine."""
