"""Training-data operators over the tables documents and pages.

Nothing else in the library imports this subpackage.
"""
