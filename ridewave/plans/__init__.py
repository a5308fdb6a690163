"""Plans of the ridewave library."""
