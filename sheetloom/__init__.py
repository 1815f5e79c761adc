"""Sheet analytics as Spark jobs: cleaning, typing, matching, approving and reporting of recognised tables."""
