"""tidelog: keyed, versioned data on Spark DataFrames.

Last-write-wins state, ordered scans, run merging and compaction, sketches, log replay and
integrity operators, and the data-preparation operators built beside them. Everything is a
DataFrame-to-DataFrame function; see README.md for the map.
"""
