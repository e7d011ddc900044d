"""Streams of candidate items: lateness and repeats natively, selection per micro-batch."""
