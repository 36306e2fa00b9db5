"""Training-data operators: filtering, deduplication, tokenisation and extraction at corpus scale.

Nothing else in :mod:`gridspark` imports this subpackage, so it can be removed whole.
"""
