"""The sources of pagewright."""
