"""The contact log as a stream: upserts, presence, chat, tumbling counts."""
