"""Functions of the course-transfer engine."""
