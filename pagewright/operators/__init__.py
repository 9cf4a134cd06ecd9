"""The operators of pagewright."""
