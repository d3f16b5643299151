"""Reading named tables and writing results."""
