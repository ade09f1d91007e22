"""Column functions, distribution tails and distributed order statistics."""
