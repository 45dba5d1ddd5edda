"""Column expressions: draws that depend only on keys, and 3-D geometry."""
