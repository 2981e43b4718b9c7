"""Training-data operators: filters, deduplication, tokenising, packing, media, sharding, chat.

Nothing else in leafmill imports this subpackage.
"""
