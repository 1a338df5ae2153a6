"""End-to-end workloads and the query registry."""
