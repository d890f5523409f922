"""Training-data operators: mixing, classifiers, language models, tokenizing, de-duplication.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
