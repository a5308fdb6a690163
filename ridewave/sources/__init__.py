"""Sources of the ridewave library."""
