"""linkloom: record linkage and training-data preparation as DataFrame operators on Spark."""
