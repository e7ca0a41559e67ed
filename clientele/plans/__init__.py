"""End-to-end runs composed from the operators."""
