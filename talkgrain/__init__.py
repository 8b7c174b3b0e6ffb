"""talkgrain: transcript, session and corpus analytics as PySpark DataFrame functions."""
