"""Streams: the one running aggregate that the batch operators can take from a stream."""
