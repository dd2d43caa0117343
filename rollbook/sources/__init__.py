"""Reading registers and findings, writing results."""
