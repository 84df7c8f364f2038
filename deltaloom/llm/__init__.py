"""Training-data operators: dedup, quality, decontamination, tokens, chat, secrets, archives.

Nothing outside this subpackage imports it; the repository works with it removed.
"""
