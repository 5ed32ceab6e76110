"""Count-based stream retention and frame processing on PySpark."""
