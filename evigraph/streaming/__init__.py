"""Change streams: coalescing, snapshots in micro-batches, and event-time windows."""
