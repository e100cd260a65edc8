"""DataFrame operators over conversations, notes and memories."""
