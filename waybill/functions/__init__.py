"""Column functions, and a few that add staged columns to a DataFrame. All run on the JVM unless noted."""
