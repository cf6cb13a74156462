"""Choices between physical strategies, from sizes known on the driver."""
