"""Multi-step jobs and what they keep between steps."""
