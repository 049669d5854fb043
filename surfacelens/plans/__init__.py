"""End-to-end workloads and the registered queries."""
