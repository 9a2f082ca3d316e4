"""Reading batches and locations, writing results."""
