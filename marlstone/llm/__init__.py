"""Operations for large-scale training-data pipelines.

The subpackage is self-contained: nothing else in the library imports it, and
it imports nothing from the rest of the library.
"""
