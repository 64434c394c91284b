"""Queries over the driver's tables; importing `registry` alone registers nothing but its own."""
