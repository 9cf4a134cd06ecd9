"""The functions of pagewright."""
