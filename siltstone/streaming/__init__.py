"""Streams: the pipeline over file and UDP streams, and late data with watermarks."""
