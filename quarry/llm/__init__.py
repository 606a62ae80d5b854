"""Training-data operators: dedup, quality, scans, packing, mixing, chat, HTML.

Nothing else in the library imports this subpackage.  ``queries`` registers
the driver queries ``op1_*`` ... ``op10_*`` and ``pipeline``.
"""
