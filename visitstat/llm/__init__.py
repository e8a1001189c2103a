"""Training-data operators: language ID, search, token files, language-model
scoring, chat formatting, near-duplicate links, source mixing, packing, page
extraction and host-level quality rules.

Nothing else in the library imports this package; it imports the library's
general helpers (session settings, written tables, checked broadcasts).
"""
