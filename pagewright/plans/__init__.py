"""The plans of pagewright."""
