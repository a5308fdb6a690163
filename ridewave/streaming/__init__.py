"""Streaming of the ridewave library."""
