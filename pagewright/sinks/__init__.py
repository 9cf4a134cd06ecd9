"""The sinks of pagewright."""
