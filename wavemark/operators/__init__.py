"""The stages between audio and answers."""
