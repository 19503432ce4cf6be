"""Plans of the course-transfer engine."""
