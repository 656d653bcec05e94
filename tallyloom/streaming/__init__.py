"""Incremental work: micro-batches, state of completed units, event-time windows."""
