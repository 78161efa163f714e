"""The engine computes over finite arrays; it has no streaming operators of its own."""
