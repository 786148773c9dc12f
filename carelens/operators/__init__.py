"""DataFrame operators: staging, marts, checks, detectors, models, review."""
