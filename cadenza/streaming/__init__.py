"""Event streams: sessions and running state of each sequence."""
