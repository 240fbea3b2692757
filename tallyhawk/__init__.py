"""Event correlation on Spark: keyed time-window detections as DataFrame operators."""
