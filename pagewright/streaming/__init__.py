"""The streaming of pagewright."""
