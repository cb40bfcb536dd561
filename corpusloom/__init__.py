"""corpusloom: a PySpark-native engine for documentation corpora.

DataFrames in, DataFrames out.  Logical plans are declared with the DataFrame
API so that Catalyst picks the physical strategy; Arrow batch functions are
used only where the work is sequential by nature (HTML walking, greedy
packing, URL resolution corner cases).
"""
