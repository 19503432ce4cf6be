"""Sources of the course-transfer engine."""
