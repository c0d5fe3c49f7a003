"""The modules whose queries are registered."""

from . import chat, decontaminate, langid, main_text, mixing, near_dedup, prefix_trie, pseudonyms, quality, sharding, spelling, tokens, toxicity

MODULES = [decontaminate, chat, near_dedup, mixing, quality, toxicity, pseudonyms, langid, tokens, sharding, spelling, prefix_trie, main_text]
