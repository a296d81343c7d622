"""Composed jobs (pre-training data, fine-tuning data, scrubbing) and the query catalog."""
