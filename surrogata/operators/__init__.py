"""DataFrame -> DataFrame operators (S: pure SQL expressions, A: Arrow partial sums)."""
