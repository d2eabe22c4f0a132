"""Column expressions: hashes and partition numbers, sliding-sketch arithmetic."""
