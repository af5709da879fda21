"""Operators of a training-data pipeline: PII, mixing, packing, quality, token counts, deduplication, search, WARC.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when it is present.
"""
