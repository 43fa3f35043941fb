"""tidewright: camera and sensor event-stream analytics on PySpark DataFrames."""
