"""Operators of the course-transfer engine."""
