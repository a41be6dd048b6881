"""Column functions and statistics shared by the operators."""
