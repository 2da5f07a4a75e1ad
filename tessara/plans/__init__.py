"""Building blocks of plans: moments, exact ranks, matrices in long form, and the query catalogue."""
