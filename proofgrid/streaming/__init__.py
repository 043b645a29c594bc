"""Continuous rule matching, case verdicts, liveness and noise with Structured Streaming."""
