"""Training-data operators: dedup, tokens, chat, toxicity, media, mixing and scoring.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
