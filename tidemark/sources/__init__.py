"""Where points live: segments, the write log, and framed binary files."""
