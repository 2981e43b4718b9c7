"""leafmill subpackage."""
