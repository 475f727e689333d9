"""The vote operators over a stream."""
