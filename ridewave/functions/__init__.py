"""Functions of the ridewave library."""
