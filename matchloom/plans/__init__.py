"""End-to-end flows, the record fixture and the query catalog."""
