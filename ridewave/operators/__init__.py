"""Operators of the ridewave library."""
