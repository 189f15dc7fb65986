"""From statement text to a checked tree, and from that to DataFrames."""
