"""Training-data operators: web archives, language models, scans, classifiers and de-duplication.

Nothing else in the package imports this subpackage.
"""
