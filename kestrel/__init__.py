"""PySpark-native analytics for time-resolved behavioural experiments and text corpora."""
