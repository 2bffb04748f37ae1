"""Structured Streaming operators (I1, I2) and their batch twins."""
