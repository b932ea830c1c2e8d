"""Query plans: named frames, and the queries over them."""
