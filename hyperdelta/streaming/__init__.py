"""The log as a stream: filtered subscriptions, bounded buffers, views kept up to date."""
