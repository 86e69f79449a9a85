"""Training-data operators: near-duplicates, mixing, packing, filtering, formatting.

Nothing outside this folder (and the pipeline at the repository top) imports it.
"""
