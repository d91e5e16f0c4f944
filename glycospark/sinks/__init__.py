"""Writers for patient partitions, splits, results and leaderboards."""
