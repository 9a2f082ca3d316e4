"""The standing questions over a stream of batches."""
