"""Where data comes from and goes to: generators, run files, result tables."""
