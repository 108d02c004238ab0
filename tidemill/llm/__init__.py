"""Training-data operators: decontamination, scans, near-duplicates, packing and text models.

Nothing outside this subpackage imports it; ``tidemill.llm.entry`` lists its queries.
"""
