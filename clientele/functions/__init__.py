"""Column-level building blocks: time, rules, hashing and text."""
