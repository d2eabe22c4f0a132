"""Graph operators over edge and vertex frames."""
